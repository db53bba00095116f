"""Streams over the events table, run to completion, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsloom.functions.integers import floor_div
from oddsloom.operators import quality as ql
from oddsloom.plans.analogs import DAY_NS, TICKS, Tables, nanos
from oddsloom.plans.features import _window_sql
from oddsloom.plans.registry import query
from oddsloom.streaming import gate, ladder
from oddsloom.streaming import run as st
from oddsloom.streaming.feeds import feed_watch
from oddsloom.streaming.venue import venue_features

HOUR = 3_600_000_000_000
# Accepted identifiers the gate remembers (a fixed value; the operators themselves forget none).
GATE_MEMORY = 100_000

# Availability jitters back, identifiers repeat now and then, receipts are sometimes late.
GATE_SQL = f"""WITH RECURSIVE {TICKS},
ev AS (
  SELECT user_id, event_id AS pos, 'h' || (event_id - CASE WHEN size % 9 = 0 THEN event_id % 400 ELSE 0 END) % 700 AS ident,
         ts_ns - CASE WHEN size % 7 = 0 THEN {9 * HOUR} ELSE 0 END AS available_ts, ts_ns AS source_ts,
         CASE WHEN size % 4 > 0 THEN ts_ns + size * 15000000 END AS receive_ts,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n
  FROM ticks),
g(user_id, n, pos, status, epoch, last, seen, stale) AS (
  SELECT user_id, n, pos, 'accepted', 0, available_ts, [ident], coalesce(abs(receive_ts - source_ts) > 1000000000, false) FROM ev WHERE n = 1
  UNION ALL
  SELECT e.user_id, e.n, e.pos,
         CASE WHEN list_contains(g.seen, e.ident) THEN 'duplicate' WHEN e.available_ts < g.last THEN 'out_of_order' ELSE 'accepted' END,
         CASE WHEN NOT list_contains(g.seen, e.ident) AND e.available_ts < g.last THEN g.epoch + 1 ELSE g.epoch END,
         CASE WHEN list_contains(g.seen, e.ident) THEN g.last WHEN e.available_ts < g.last THEN NULL ELSE e.available_ts END,
         CASE WHEN list_contains(g.seen, e.ident) THEN g.seen WHEN e.available_ts < g.last THEN [] ELSE list_append(g.seen, e.ident) END,
         coalesce(NOT list_contains(g.seen, e.ident) AND NOT coalesce(e.available_ts < g.last, false) AND abs(e.receive_ts - e.source_ts) > 1000000000, false)
  FROM g JOIN ev e ON e.user_id = g.user_id AND e.n = g.n + 1)"""
GATE_ROWS = f"{GATE_SQL} SELECT user_id, pos, status, CAST(epoch AS BIGINT) AS epoch_id, stale FROM g"


def gate_events(ticks, *more: str):
    size, ts = F.col("size"), F.col("ts_ns")
    shift = F.when(size % 9 == 0, F.col("event_id") % 400).otherwise(0)
    return ticks.select(
        "user_id", F.col("event_id").alias("pos"),
        F.concat(F.lit("h"), ((F.col("event_id") - shift) % 700).cast("string")).alias("identifier"),
        (ts - F.when(size % 7 == 0, 9 * HOUR).otherwise(0)).alias("available_ts"), ts.alias("source_ts"),
        F.when(size % 4 > 0, ts + size * 15_000_000).alias("receive_ts"), *more,
    )


def stream_ticks(t: Tables):
    raw = st.read_stream(t.spark, t.path("events"))
    return raw.select(
        "user_id", nanos("ts").alias("ts_ns"), "event_id", "event_type", (F.col("value") / 500).alias("price"),
        F.get_json_object("props", "$.k").cast("int").alias("size"), F.col("ts").cast("timestamp").alias("ts"),
    )


# The same events, every thirteenth size being a gap mark instead.
GAP_SQL = (
    GATE_SQL.replace("AS ident,", "AS ident, size % 13 = 5 AS gap,", 1)
    .replace("SELECT user_id, n, pos, 'accepted', 0, available_ts, [ident], coalesce(abs(receive_ts - source_ts) > 1000000000, false) FROM ev WHERE n = 1",
             "SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, 0, NULL::BIGINT, []::VARCHAR[], false FROM ev")
    .replace("CASE WHEN list_contains(g.seen, e.ident) THEN 'duplicate'", "CASE WHEN e.gap THEN 'gap' WHEN list_contains(g.seen, e.ident) THEN 'duplicate'")
    .replace("CASE WHEN NOT list_contains(g.seen, e.ident) AND e.available_ts < g.last THEN g.epoch + 1", "CASE WHEN e.gap OR NOT list_contains(g.seen, e.ident) AND e.available_ts < g.last THEN g.epoch + 1")
    .replace("CASE WHEN list_contains(g.seen, e.ident) THEN g.last", "CASE WHEN e.gap THEN NULL WHEN list_contains(g.seen, e.ident) THEN g.last")
    .replace("CASE WHEN list_contains(g.seen, e.ident) THEN g.seen", "CASE WHEN e.gap THEN [] WHEN list_contains(g.seen, e.ident) THEN g.seen")
    .replace("coalesce(NOT list_contains", "NOT e.gap AND coalesce(NOT list_contains")
)
GAP_ROWS = f"{GAP_SQL} SELECT user_id, pos, status, CAST(epoch AS BIGINT) AS epoch_id, stale FROM g WHERE n > 0"


def gap_events(ticks):
    return gate_events(ticks.withColumn("gap", F.col("size") % 13 == 5), "gap", "ts", "ts_ns")


@query("gap_gate", "T2", GAP_ROWS)
def _gap_gate(t: Tables):
    out = ql.quality_gate(
        gap_events(t.ticks.withColumn("ts", F.lit(None))), keys=["user_id"], pos="pos", identifier="identifier", available="available_ts", source_ts="source_ts",
        receive_ts="receive_ts", width=5_000, gap=F.col("gap"),
    )
    return out.select("user_id", "pos", "status", "epoch_id", "stale")


@query("stream_gap_gate", "T1 T2", GAP_ROWS)
def _stream_gap_gate(t: Tables):
    marked = gap_events(stream_ticks(t)).withWatermark("ts", "1 hour")
    return st.drain(gate.quality_marks(marked, idle_ns=30 * DAY_NS))


@query(
    "gap_counters",
    "A34 T2",
    f"""{GAP_SQL} SELECT user_id, count(*) FILTER (status <> 'gap') AS total_events, count(*) FILTER (status = 'accepted') AS accepted_events, count(*) FILTER (status = 'duplicate') AS duplicate_events,
    count(*) FILTER (status = 'out_of_order') AS out_of_order_events, count(*) FILTER (stale) AS stale_events, count(*) FILTER (status = 'gap') AS gap_events, CAST(max(epoch) + 1 AS BIGINT) AS epochs FROM g WHERE n > 0 GROUP BY 1""",
)
def _gap_counters(t: Tables):
    out = ql.quality_gate(
        gap_events(t.ticks.withColumn("ts", F.lit(None))), keys=["user_id"], pos="pos", identifier="identifier", available="available_ts", source_ts="source_ts",
        receive_ts="receive_ts", width=5_000, gap=F.col("gap"), rounds=1, replay_rows=10_000,
    )
    return ql.quality_counters(out, keys=["user_id"], gaps=True)


@query("quality_gate", "T1 T2", GATE_ROWS)
def _gate(t: Tables):
    out = ql.quality_gate(
        gate_events(t.ticks), keys=["user_id"], pos="pos", identifier="identifier", available="available_ts",
        source_ts="source_ts", receive_ts="receive_ts", width=5_000, max_seen=GATE_MEMORY,
    )
    return out.select("user_id", "pos", "status", "epoch_id", "stale")


@query("stream_quality_gate", "T1 T2", GATE_ROWS)
def _stream_gate(t: Tables):
    return st.drain(gate.quality_marks(gate_events(stream_ticks(t)), max_seen=GATE_MEMORY))


@query(
    "quality_counters",
    "A34",
    f"""{GATE_SQL} SELECT user_id, count(*) AS total_events, count(*) FILTER (WHERE status = 'accepted') AS accepted_events, count(*) FILTER (WHERE status = 'duplicate') AS duplicate_events,
    count(*) FILTER (WHERE status = 'out_of_order') AS out_of_order_events, count(*) FILTER (WHERE stale) AS stale_events, CAST(max(epoch) + 1 AS BIGINT) AS epochs FROM g GROUP BY 1""",
)
def _counters(t: Tables):
    out = ql.quality_gate(
        gate_events(t.ticks), keys=["user_id"], pos="pos", identifier="identifier", available="available_ts",
        source_ts="source_ts", receive_ts="receive_ts", width=5_000,
    )
    return ql.quality_counters(out, keys=["user_id"])


@query(
    "monotone_availability",
    "N14",
    f"""WITH {TICKS},
    e AS (SELECT user_id, event_id, ts_ns - size * 600000000000 AS src, ts_ns - size * 590000000000 AS rec FROM ticks),
    b AS (SELECT *, coalesce(src + {HOUR} <= lag(src) OVER (PARTITION BY user_id ORDER BY event_id), false) AS back FROM e),
    p AS (SELECT *, sum(CASE WHEN back THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS part FROM b)
    SELECT user_id, event_id, max(greatest(src, rec)) OVER (PARTITION BY user_id, part ORDER BY event_id) AS available_ts FROM p""",
)
def _monotone(t: Tables):
    rows = t.ticks.select(
        "user_id", "event_id", (F.col("ts_ns") - F.col("size") * 600_000_000_000).alias("src"),
        (F.col("ts_ns") - F.col("size") * 590_000_000_000).alias("rec"),
    )
    return ql.monotone_availability(
        rows, keys=["user_id"], order=["event_id"], source_ts="src", receive_ts="rec", width=2_000, tolerance_ns=HOUR
    ).select("user_id", "event_id", "available_ts")


def book_stream(ticks):
    """Views are snapshots, clicks and purchases changes of one side."""
    b = (F.lit(10) + F.col("size") % 60).cast("double") / 100
    lvl = lambda p, s: F.struct(F.round(p, 2).alias("price"), s.cast("double").alias("size"))
    is_book = F.col("event_type") == "view"
    none = F.array().cast("array<struct<price:double,size:double>>")
    bids = F.array(lvl(b - 0.01, F.col("size") % 5 + 1), lvl(b - 0.02, F.col("size") % 3 + 1))
    asks = F.array(lvl(b + 0.01, F.col("size") % 4 + 1), lvl(b + 0.02, F.col("size") % 3 + 1))
    is_click = F.col("event_type") == "click"
    return ticks.filter("event_type IN ('view', 'click', 'purchase', 'signup')").select(
        F.col("user_id").alias("asset_id"), F.col("event_id").alias("pos"), F.col("ts_ns").alias("source_ts"),
        (F.col("ts_ns") + F.col("size") * 1_000_000).alias("receive_ts"),
        F.when(is_book, "book").when(F.col("event_type") == "signup", "last_trade_price").otherwise("price_change").alias("event_type"),
        F.when(is_book, bids).otherwise(none).alias("bids"), F.when(is_book, asks).otherwise(none).alias("asks"),
        F.when(is_click, "BUY").otherwise("SELL").alias("side"),
        F.round(F.when(is_click, b - 0.03).otherwise(b + 0.03), 2).alias("price"),
        (F.col("size") % 6).cast("double").alias("size"),
    )


_LEVEL = "STRUCT(p DOUBLE, s DOUBLE)[]"
TOKEN_SQL = f"""WITH RECURSIVE {TICKS},
ev AS (
  SELECT user_id, event_id AS pos, ts_ns AS source_ts, ts_ns + size * 1000000 AS receive_ts, event_type, (size % 6)::DOUBLE AS size,
         round(CASE WHEN event_type = 'click' THEN b - 0.03 ELSE b + 0.03 END, 2) AS price, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
         [{{'p': round(b - 0.01, 2), 's': (size % 5 + 1)::DOUBLE}}, {{'p': round(b - 0.02, 2), 's': (size % 3 + 1)::DOUBLE}}]::{_LEVEL} AS bids,
         [{{'p': round(b + 0.01, 2), 's': (size % 4 + 1)::DOUBLE}}, {{'p': round(b + 0.02, 2), 's': (size % 3 + 1)::DOUBLE}}]::{_LEVEL} AS asks
  FROM (SELECT *, (10 + size % 60)::DOUBLE / 100 AS b FROM ticks) WHERE event_type IN ('view', 'click', 'purchase', 'signup')),
g(user_id, n, pos, status, known, ready, available, source, bids, asks) AS (
  SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT, false, NULL::BIGINT, NULL::BIGINT, []::{_LEVEL}, []::{_LEVEL} FROM ev
  UNION ALL
  SELECT user_id, n, pos, status, known, CASE WHEN event_type = 'signup' OR status = 'awaiting_snapshot' THEN ready ELSE sound END,
         CASE WHEN status = 'applied' THEN known ELSE available END, CASE WHEN status = 'applied' THEN source_ts ELSE source END,
         CASE WHEN status = 'awaiting_snapshot' THEN old_bids ELSE nb END, CASE WHEN status = 'awaiting_snapshot' THEN old_asks ELSE na END
  FROM (
    SELECT *, CASE WHEN event_type IN ('click', 'purchase') AND NOT ready THEN 'awaiting_snapshot' WHEN event_type = 'signup' OR sound THEN 'applied' ELSE 'invalid' END AS status
    FROM (
      SELECT *, coalesce(list_max(list_transform(nb, lambda x: x.p)) < list_min(list_transform(na, lambda x: x.p)), false) AS sound
      FROM (
        SELECT e.user_id, e.n, e.pos, e.event_type, e.source_ts, g.ready, g.available, g.source, g.bids AS old_bids, g.asks AS old_asks,
               CASE WHEN g.available IS NOT NULL AND e.source_ts + 1000000000 > g.source THEN greatest(e.receive_ts, e.source_ts, g.available) ELSE greatest(e.receive_ts, e.source_ts) END AS known,
               CASE e.event_type WHEN 'view' THEN e.bids WHEN 'click' THEN list_filter(g.bids, lambda x: x.p <> e.price) || CASE WHEN e.size <> 0 THEN [{{'p': e.price, 's': e.size}}]::{_LEVEL} ELSE []::{_LEVEL} END ELSE g.bids END AS nb,
               CASE e.event_type WHEN 'view' THEN e.asks WHEN 'purchase' THEN list_filter(g.asks, lambda x: x.p <> e.price) || CASE WHEN e.size <> 0 THEN [{{'p': e.price, 's': e.size}}]::{_LEVEL} ELSE []::{_LEVEL} END ELSE g.asks END AS na
        FROM g JOIN ev e ON e.user_id = g.user_id AND e.n = g.n + 1))))
SELECT user_id AS asset_id, pos, status, known AS available_ts, CASE WHEN shown THEN b.p END AS bid, CASE WHEN shown THEN a.p END AS ask,
       CASE WHEN shown THEN b.s END AS bid_size, CASE WHEN shown THEN a.s END AS ask_size
FROM (SELECT g.*, g.status = 'applied' AND e.event_type <> 'signup' AS shown, list_sort(g.bids, 'DESC')[1] AS b, list_sort(g.asks)[1] AS a
      FROM g JOIN ev e ON e.user_id = g.user_id AND e.n = g.n)"""


@query("stream_token_books", "T4", TOKEN_SQL)
def _token_books(t: Tables):
    rows = book_stream(stream_ticks(t)).withColumns({"ts_ns": F.col("source_ts"), "ts": F.timestamp_micros(F.expr("source_ts div 1000"))})
    books = ladder.TokenBooks(idle_ns=30 * DAY_NS)
    return st.drain(st.process(rows.withWatermark("ts", "1 hour"), ["asset_id"], books, time_mode="EventTime"))


def depth_stream(ticks):
    """A snapshot every sign-up, some of them old; deltas with contiguous ids but for some dropped ones."""
    size, b = F.col("size"), (F.lit(10) + F.col("size") % 60).cast("double") / 100
    lvl = lambda p, s: F.struct(F.round(p, 2).alias("price"), s.cast("double").alias("size"))
    snap = F.col("event_type") == "signup"
    final = F.col("event_id") * 10
    return ticks.select(
        "user_id", F.col("event_id").alias("pos"), "ts", "ts_ns", F.when(snap, "snapshot").otherwise("delta").alias("kind"),
        F.when(~snap & (size % 11 == 0), final - 3).otherwise(0).cast("bigint").alias("first_id"),
        F.when(snap, final - 5 - size % 3 * 3000).otherwise(final).cast("bigint").alias("final_id"),
        F.array(lvl(b - 0.01, size % 5), lvl(b - 0.05, size % 3 + 1)).alias("bids"),
        F.array(lvl(b + 0.01, size % 4), lvl(b + 0.05, size % 3 + 1)).alias("asks"),
    )


_ITEM = f"STRUCT(a BIGINT, z BIGINT, bids {_LEVEL}, asks {_LEVEL})"
_PUT = "list_filter({0}, lambda x: NOT list_contains(list_transform({1}, lambda y: y.p), x.p)) || list_filter({1}, lambda x: x.s <> 0)"
# One step takes the next event, or one held update behind a snapshot.
DEPTH_SQL = f"""WITH RECURSIVE {TICKS},
ev AS (
  SELECT user_id, event_id AS pos, event_type = 'signup' AS snap, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
         {{'a': CASE WHEN event_type <> 'signup' AND size % 11 = 0 THEN event_id * 10 - 3 ELSE 0 END, 'z': CASE WHEN event_type = 'signup' THEN event_id * 10 - 5 - size % 3 * 3000 ELSE event_id * 10 END,
           'bids': [{{'p': round(b - 0.01, 2), 's': (size % 5)::DOUBLE}}, {{'p': round(b - 0.05, 2), 's': (size % 3 + 1)::DOUBLE}}],
           'asks': [{{'p': round(b + 0.01, 2), 's': (size % 4)::DOUBLE}}, {{'p': round(b + 0.05, 2), 's': (size % 3 + 1)::DOUBLE}}]}}::{_ITEM} AS u
  FROM (SELECT *, (10 + size % 60)::DOUBLE / 100 AS b FROM ticks)),
g(user_id, n, pos, status, told, last, bids, asks, held, todo) AS (
  SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, false, NULL::BIGINT, []::{_LEVEL}, []::{_LEVEL}, []::{_ITEM}[], []::{_ITEM}[] FROM ev
  UNION ALL
  SELECT user_id, n, pos, status, CASE act WHEN 'start' THEN len(ahead) = 0 WHEN 'follow' THEN len(ahead) = 1 OR status = 'gap' ELSE true END,
         CASE WHEN act = 'start' THEN u.z WHEN status IN ('gap', 'awaiting_snapshot') THEN NULL WHEN status = 'applied' THEN u.z ELSE last END,
         CASE WHEN act = 'start' THEN list_filter(u.bids, lambda x: x.s <> 0) WHEN status IN ('gap', 'awaiting_snapshot') THEN [] WHEN status = 'applied' THEN {_PUT.format('bids', 'u.bids')} ELSE bids END,
         CASE WHEN act = 'start' THEN list_filter(u.asks, lambda x: x.s <> 0) WHEN status IN ('gap', 'awaiting_snapshot') THEN [] WHEN status = 'applied' THEN {_PUT.format('asks', 'u.asks')} ELSE asks END,
         CASE WHEN act = 'hold' THEN list_append(held, u) WHEN act = 'delta' AND status = 'gap' THEN [u] WHEN act = 'follow' AND status = 'gap' THEN ahead
              WHEN act = 'old' THEN held WHEN act = 'delta' THEN held ELSE []::{_ITEM}[] END,
         CASE WHEN act = 'start' THEN ahead WHEN act = 'follow' AND status <> 'gap' THEN ahead[2:] ELSE []::{_ITEM}[] END
  FROM (
    SELECT *, CASE WHEN act IN ('hold', 'old') THEN 'awaiting_snapshot' WHEN act = 'start' THEN 'applied' WHEN u.z <= last THEN 'stale' WHEN u.a <= last + 1 THEN 'applied' ELSE 'gap' END AS status
    FROM (
      SELECT *, CASE WHEN waits THEN 'follow' WHEN NOT snap AND last IS NULL THEN 'hold' WHEN NOT snap THEN 'delta' WHEN len(ahead) > 0 AND ahead[1].a > u.z + 1 THEN 'old' ELSE 'start' END AS act
      FROM (
        SELECT g.user_id, coalesce(e.n, g.n) AS n, coalesce(e.pos, g.pos) AS pos, e.snap, g.last, g.bids, g.asks, g.held, len(g.todo) > 0 AS waits,
               CASE WHEN len(g.todo) > 0 THEN g.todo[1] ELSE e.u END AS u, CASE WHEN len(g.todo) > 0 THEN g.todo ELSE list_filter(g.held, lambda x: x.z > e.u.z) END AS ahead
        FROM g LEFT JOIN ev e ON e.user_id = g.user_id AND e.n = g.n + 1 AND len(g.todo) = 0 WHERE len(g.todo) > 0 OR e.n IS NOT NULL))))
SELECT user_id, pos, status, last AS last_id, CASE WHEN shown THEN b.p END AS bid, CASE WHEN shown THEN a.p END AS ask, CASE WHEN shown THEN b.s END AS bid_size, CASE WHEN shown THEN a.s END AS ask_size
FROM (SELECT *, coalesce(status = 'applied' AND b.p < a.p, false) AS shown FROM (SELECT *, list_sort(bids, 'DESC')[1] AS b, list_sort(asks)[1] AS a FROM g WHERE told))"""


@query("stream_depth_sync", "T3", DEPTH_SQL)
def _depth(t: Tables):
    rows = depth_stream(stream_ticks(t)).withWatermark("ts", "1 hour")
    return st.drain(st.process(rows, ["user_id"], ladder.DepthSync(idle_ns=30 * DAY_NS), time_mode="EventTime"))


def trailing_stream(ticks):
    return ticks.filter("event_type IN ('view', 'click', 'purchase')").select(
        "user_id", "event_id", "ts_ns", (F.col("event_type") != "view").alias("is_trade"), "price",
        F.col("size").cast("double").alias("quantity"),
        F.when(F.col("event_type") == "click", 1.0).otherwise(-1.0).alias("sign"),
    )


@query(
    "stream_trailing_features",
    "T5",
    f"""WITH {TICKS},
    trades AS (
      SELECT user_id, ts_ns, price, price * size AS notional, CASE side WHEN 'BUY' THEN price * size ELSE -price * size END AS signed,
             lag(ts_ns) OVER w AS prev_ts, ln(price / lag(price) OVER w) ** 2 AS r2
      FROM ticks WHERE event_type IN ('click', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    decisions AS (SELECT k.user_id, k.event_id, k.ts_ns, t.price AS last_price FROM ticks k ASOF LEFT JOIN trades t ON k.user_id = t.user_id AND k.ts_ns >= t.ts_ns WHERE k.event_type = 'view')
    SELECT user_id, event_id, ts_ns, return_x AS ret, rv_x AS rv, flow_x AS flow FROM (
      SELECT d.user_id, d.event_id, d.ts_ns, {_window_sql({"x": 2 * DAY_NS})}
      FROM decisions d LEFT JOIN trades t ON t.user_id = d.user_id AND t.ts_ns <= d.ts_ns AND t.ts_ns >= d.ts_ns - {2 * DAY_NS} GROUP BY 1, 2, 3)""",
)
def _trailing(t: Tables):
    out = st.drain(st.process(trailing_stream(stream_ticks(t)), ["user_id"], gate.TrailingTrades(2 * DAY_NS)))
    return out.select("user_id", "event_id", "ts_ns", *[F.round(c, 6).alias(c) for c in ("ret", "rv", "flow")])


# Days and hours stand in for seconds and milliseconds.
VENUE_WINDOWS = {"1s": DAY_NS, "5s": 2 * DAY_NS, "15s": 3 * DAY_NS, "30s": 4 * DAY_NS, "60s": 6 * DAY_NS, "300s": 9 * DAY_NS}
VENUE_RETENTION = 10 * DAY_NS
_INSIDE = {w: f"FILTER (WHERE t.ts_ns >= d.ts_ns - {span})" for w, span in VENUE_WINDOWS.items()}


def venue_rows(ticks):
    """Clicks and purchases are trades, sign-ups books, errors references or now and then gap marks, views decisions."""
    size, price = F.col("size"), F.col("price")
    kinds = {"click": "trade", "purchase": "trade", "signup": "book", "view": "decision"}
    kind = F.when((F.col("event_type") == "error") & (size % 19 == 0), "gap").when(F.col("event_type") == "error", "reference")
    for name, means in kinds.items():
        kind = kind.when(F.col("event_type") == name, means)
    return ticks.select(
        "user_id", F.col("event_id").alias("pos"), "ts_ns", "ts", kind.alias("kind"), "price", size.cast("double").alias("quantity"),
        F.when(F.col("event_type") == "click", 1.0).otherwise(-1.0).alias("sign"), (price - 0.01).alias("bid"), (price + 0.01).alias("ask"),
        (size + 1).cast("double").alias("bid_size"), (size + 2).cast("double").alias("ask_size"), (F.col("ts_ns") - size * HOUR).alias("source_ns"),
        (F.col("ts_ns") - (size % 40) * HOUR).alias("start_ns"),
    )


@query(
    "stream_venue_features",
    "T5",
    f"""WITH {TICKS},
    k AS (SELECT *, CASE WHEN event_type IN ('click', 'purchase') THEN 'trade' WHEN event_type = 'signup' THEN 'book' WHEN event_type = 'view' THEN 'decision'
                         WHEN size % 19 = 0 THEN 'gap' ELSE 'reference' END AS kind FROM ticks),
    f AS (SELECT *, count(*) FILTER (kind = 'gap') OVER (PARTITION BY user_id ORDER BY ts_ns, event_id) AS seg FROM k),
    d AS (SELECT a.user_id, a.event_id, a.ts_ns, a.ts_ns - (a.size % 40) * {HOUR} AS start_ns, count(g.event_id) AS seg
          FROM k a LEFT JOIN k g ON g.kind = 'gap' AND g.user_id = a.user_id AND g.ts_ns <= a.ts_ns
          WHERE a.kind = 'decision' AND a.ts_ns // 1000000 + 1 <= (SELECT max(epoch_ms(ts)) - 3600000 FROM events) GROUP BY ALL),
    t AS (SELECT user_id, seg, ts_ns, event_id, price, price * size AS notional, CASE event_type WHEN 'click' THEN price * size ELSE -price * size END AS signed,
                 lag(ts_ns) OVER w AS prev_ts, ln(price / lag(price) OVER w) ** 2 AS r2
          FROM f WHERE kind = 'trade' AND price > 0 WINDOW w AS (PARTITION BY user_id, seg ORDER BY ts_ns, event_id)),
    w AS (SELECT d.event_id, arg_max(t.price, (t.ts_ns, t.event_id)) AS last_price, max(t.ts_ns) AS last_trade_ns, {", ".join(
        f"round(coalesce(ln(arg_max(t.price, (t.ts_ns, t.event_id)) {i} / arg_min(t.price, (t.ts_ns, t.event_id)) {i}), 0), 6) AS return_{w}, "
        f"round(sqrt(coalesce(sum(t.r2) FILTER (WHERE t.prev_ts >= d.ts_ns - {VENUE_WINDOWS[w]}), 0)), 6) AS rv_{w}, "
        f"round(coalesce(sum(t.signed) {i} / nullif(sum(t.notional) {i}, 0), 0), 6) AS flow_{w}" for w, i in _INSIDE.items())}
          FROM d LEFT JOIN t ON t.user_id = d.user_id AND t.seg = d.seg AND t.ts_ns <= d.ts_ns GROUP BY d.event_id),
    b AS (SELECT d.event_id, arg_max({{'p': f.price, 's': f.size, 't': f.ts_ns}}, (f.ts_ns, f.event_id)) AS b
          FROM d JOIN f ON f.kind = 'book' AND f.user_id = d.user_id AND f.seg = d.seg AND f.ts_ns <= d.ts_ns GROUP BY 1),
    r AS (SELECT d.event_id, d.start_ns, f.price, f.ts_ns, f.event_id AS no, f.ts_ns - f.size * {HOUR} AS source_ns, max(f.ts_ns) OVER (PARTITION BY d.event_id) AS newest
          FROM d JOIN f ON f.kind = 'reference' AND f.user_id = d.user_id AND f.seg = d.seg AND f.ts_ns <= d.ts_ns),
    o AS (SELECT event_id, arg_max(price, (ts_ns, no)) AS latest_reference, max(ts_ns) AS latest_reference_ns,
                 arg_max(price, (ts_ns, no)) FILTER (WHERE ts_ns >= newest - {VENUE_RETENTION} AND source_ns <= start_ns) AS opening_reference FROM r GROUP BY 1)
    SELECT d.user_id, d.event_id AS pos, d.ts_ns, w.* EXCLUDE (event_id), round(b.b.p - 0.01, 6) AS bid, round(b.b.p + 0.01, 6) AS ask, b.b.s + 1.0::DOUBLE AS bid_size,
           b.b.s + 2.0::DOUBLE AS ask_size, b.b.t AS book_ns, o.latest_reference, o.latest_reference_ns, o.opening_reference, d.seg > 0 AS gap
    FROM d JOIN w ON w.event_id = d.event_id LEFT JOIN b ON b.event_id = d.event_id LEFT JOIN o ON o.event_id = d.event_id""",
)
def _venue(t: Tables):
    out = st.drain(venue_features(
        venue_rows(stream_ticks(t)), key="user_id", event_time="ts", late="1 hour", windows_ns=VENUE_WINDOWS, retention_ns=VENUE_RETENTION, idle_ns=30 * DAY_NS,
    ))
    exact = {"user_id", "pos", "ts_ns", "gap", "last_price", "latest_reference", "opening_reference", "last_trade_ns", "book_ns", "latest_reference_ns"}
    return out.select(*[c if c in exact else F.round(c, 6).alias(c) for c in out.columns])


@query(
    "stream_buckets",
    "T7",
    f"""WITH {TICKS} SELECT user_id, ts_ns // {HOUR} * {HOUR} AS window_start, arg_max(price, (ts_ns, event_id)) AS last_price, CAST(sum(size) AS BIGINT) AS volume, count(*) AS n FROM ticks GROUP BY 1, 2""",
)
def _buckets(t: Tables):
    stream = st.tumbling(
        stream_ticks(t), keys=["user_id"], event_time="ts", length="1 hour", late="2 days",
        aggs={
            "last_price": F.max_by("price", F.struct("ts_ns", "event_id")), "volume": F.sum("size"), "n": F.count(F.lit(1)),
        },
    )
    return st.drain(stream, mode="update", keys=["user_id", "window_start"])


@query(
    "stream_market_windows",
    "T8",
    f"""WITH {TICKS} SELECT ts_ns // {900 * 10**9} * {900 * 10**9} AS window_start, count(*) AS n, arg_min(price, (ts_ns, event_id)) AS open_price, arg_max(price, (ts_ns, event_id)) AS close_price FROM ticks GROUP BY 1""",
)
def _windows(t: Tables):
    rank = F.struct("ts_ns", "event_id")
    stream = st.tumbling(
        stream_ticks(t), keys=[], event_time="ts", length="15 minutes", late="2 days",
        aggs={"n": F.count(F.lit(1)), "open_price": F.min_by("price", rank), "close_price": F.max_by("price", rank)},
    )
    return st.drain(stream, mode="update", keys=["window_start"])


FEED_NOW = 1_704_067_200_000_000_000 + 30 * DAY_NS


@query(
    "stream_feed_health",
    "T6",
    f"""WITH {TICKS}, f AS (SELECT user_id AS feed, max(ts_ns) AS last_ts FROM ticks GROUP BY 1), r AS (SELECT c_custkey AS feed FROM customer)
    SELECT r.feed, last_ts, {FEED_NOW} - last_ts AS age_ns, CASE WHEN last_ts IS NULL THEN 'silent' WHEN r.feed % 10 = 3 THEN 'gap' WHEN {FEED_NOW} - last_ts < -5000000000 THEN 'future' WHEN {FEED_NOW} - last_ts > {12 * HOUR} THEN 'stale' ELSE 'ok' END AS state
    FROM r LEFT JOIN f ON r.feed = f.feed""",
)
def _health(t: Tables):
    feeds = stream_ticks(t).withColumnRenamed("user_id", "feed")
    ages = st.drain(st.feed_ages(feeds, feed="feed", ts="ts_ns"), mode="update", keys=["feed"])
    required = t.read("customer").select(F.col("c_custkey").alias("feed"))
    gaps = required.select("feed", F.when(F.col("feed") % 10 == 3, 1).otherwise(0).alias("gap_count"))
    return st.feed_health(ages, required, feed="feed", now=F.lit(FEED_NOW), stale_ns=12 * HOUR, gaps=gaps)


# Feeds of a year long gone, some of them with times far ahead of any clock.
AHEAD_NS = 95 * 365 * DAY_NS


@query(
    "stream_feed_watch",
    "T6",
    f"""WITH {TICKS}, f AS (SELECT user_id AS feed, max(CASE WHEN user_id % 10 = 7 THEN ts_ns + {AHEAD_NS} ELSE ts_ns END) AS last_ts FROM ticks GROUP BY 1)
    SELECT c_custkey AS feed, last_ts, CASE WHEN last_ts IS NULL THEN 'silent' WHEN c_custkey % 10 = 3 THEN 'gap' WHEN c_custkey % 10 = 7 THEN 'future' ELSE 'stale' END AS state
    FROM customer LEFT JOIN f ON c_custkey = feed""",
)
def _watch(t: Tables):
    feed = F.col("c_custkey").alias("feed")
    required = st.read_stream(t.spark, t.path("customer"))
    # Of a feed's marks the first gap is mended and the second is not.
    marks = required.filter("c_custkey % 10 = 3").select(feed, F.explode(F.array(*[F.lit(k) for k in ("gap", "mended", "gap")])).alias("kind"), F.lit(None).cast("bigint").alias("ts_ns"))
    events = stream_ticks(t).select(
        F.col("user_id").alias("feed"), F.lit("event").alias("kind"), (F.col("ts_ns") + F.when(F.col("user_id") % 10 == 7, AHEAD_NS).otherwise(0)).alias("ts_ns")
    )
    rows = required.select(feed, F.lit("required").alias("kind"), F.lit(None).cast("bigint").alias("ts_ns")).unionByName(marks).unionByName(events)
    changes = st.drain_live(feed_watch(rows, feed="feed", stale_ns=12 * HOUR))
    newest = changes.groupBy("feed").agg(F.max(F.struct("change", "last_ts", "state")).alias("now"))
    return newest.select("feed", "now.last_ts", "now.state")


@query(
    "stream_flush",
    "T9 S9 S10",
    f"""WITH {TICKS} SELECT event_type AS source, ts_ns // {DAY_NS} AS day, count(*) AS rows, min(ts_ns) AS min_ts, max(ts_ns) AS max_ts FROM ticks GROUP BY 1, 2""",
)
def _flush(t: Tables):
    from oddsloom.sources.store import manifest

    rows = stream_ticks(t).select(
        F.col("event_type").alias("source"), floor_div("ts_ns", DAY_NS).alias("day"), "user_id", "event_id", "ts_ns", "price"
    )
    flushed = st.drain(rows, partition_by=["source", "day"])
    return manifest(flushed, keys=["source", "day"], ts="ts_ns")
