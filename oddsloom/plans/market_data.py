"""Raw venue rows to deltas, trades and top-of-book states."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsloom.functions.codes import BUY_WORDS, SELL_WORDS
from oddsloom.operators import books, trades
from oddsloom.plans.analogs import DAY_NS, TICK_CHUNK, TICKS, Tables, nanos
from oddsloom.plans.registry import query
from oddsloom.session import settle

EPOCH_2024 = 1_704_067_200_000_000_000
START, END = EPOCH_2024 + 2 * DAY_NS, EPOCH_2024 + 25 * DAY_NS
FILL_WIDTH_S = 90 * 86_400
FILL_WIDTH = FILL_WIDTH_S * 1_000_000_000

# ---------------------------------------------------------------- public trades

PUBLIC = """public AS (
  SELECT CAST(epoch(l_shipdate) AS BIGINT) AS timestamp, '0x' || md5(CAST(l_orderkey AS VARCHAR)) AS transaction_hash,
         'asset' || printf('%06d', l_partkey) AS asset,
         CASE l_returnflag WHEN 'A' THEN 'BUY' WHEN 'R' THEN ' sell' ELSE 'mint' END AS side,
         printf('%d.%02d', CAST(round(l_discount * 100) AS INTEGER) // 10, CAST(round(l_discount * 100) AS INTEGER) % 10 * 10) AS price,
         CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS size
  FROM lineitem),
counted AS (
  SELECT *, row_number() OVER (PARTITION BY asset, timestamp ORDER BY transaction_hash, side, price, size) - 1 AS in_second,
         row_number() OVER (PARTITION BY transaction_hash, asset ORDER BY timestamp, side, price, size) - 1 AS in_tx,
         row_number() OVER (PARTITION BY asset ORDER BY timestamp, transaction_hash, side, price, size) - 1 AS record_index
  FROM public),
shaped AS (
  SELECT asset, CAST(price AS DOUBLE) AS price_value, CAST(size AS DOUBLE) AS size_value,
         CASE upper(trim(side)) WHEN 'BUY' THEN 1 WHEN 'SELL' THEN 2 ELSE 0 END AS aggressor_side,
         right(transaction_hash, 24) || '-' || right(asset, 4) || '-' || printf('%06d', in_tx) AS trade_id,
         timestamp * 1000000000 + least(in_second, 999999999) AS ts_event, record_index
  FROM counted)"""


def public_rows(t: Tables):
    tenths = F.round(F.col("l_discount") * 100).cast("int")
    return t.read("lineitem").select(
        (nanos("l_shipdate") / 1_000_000_000).cast("bigint").alias("timestamp"),
        F.concat(F.lit("0x"), F.md5(F.col("l_orderkey").cast("string"))).alias("transaction_hash"),
        F.concat(F.lit("asset"), F.format_string("%06d", "l_partkey")).alias("asset"),
        F.when(F.col("l_returnflag") == "A", "BUY")
        .when(F.col("l_returnflag") == "R", " sell")
        .otherwise("mint")
        .alias("side"),
        F.format_string("%d.%02d", (tenths / 10).cast("int"), tenths % 10 * 10).alias("price"),
        F.col("l_quantity").cast("int").cast("string").alias("size"),
    )


@query(
    "public_trades",
    "N6",
    f"""WITH {PUBLIC} SELECT asset, price_value, size_value, aggressor_side, trade_id, ts_event
    FROM shaped WHERE price_value > 0 AND price_value < 1""",
)
def _public(t: Tables):
    rows = trades.public_trades(public_rows(t), width_s=FILL_WIDTH_S)
    return trades.accepted_trades(rows).select(
        "asset", "price_value", "size_value", "aggressor_side", "trade_id", "ts_event"
    )


@query(
    "rejected_trades",
    "N7",
    f"""WITH {PUBLIC}
    SELECT asset, 'unexpected_side' AS reason, price_value, ts_event, trade_id FROM shaped WHERE aggressor_side = 0
    UNION ALL
    SELECT asset, 'skipped_price', price_value, ts_event, trade_id FROM shaped WHERE NOT (price_value > 0 AND price_value < 1)""",
)
def _rejected(t: Tables):
    rows = trades.public_trades(public_rows(t), width_s=FILL_WIDTH_S)
    return trades.rejected_trades(rows, token="asset", width_ns=FILL_WIDTH).select(
        "asset", "reason", "price_value", "ts_event", "trade_id"
    )


# ---------------------------------------------------------------- on-chain fills

_words = lambda words: ", ".join(f"'{w}'" for w in words)

ONCHAIN = """onchain AS (
  SELECT l_partkey AS token, epoch_us(l_shipdate) * 1000 AS timestamp_ns,
         printf('%012d-%d-%06d-%06d', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS pos,
         CASE WHEN l_linenumber = 7 THEN 'bad' ELSE printf('%d.%02d', CAST(round(l_discount * 100) AS INTEGER) // 10, CAST(round(l_discount * 100) AS INTEGER) % 10 * 10) END AS price,
         CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS size,
         CASE l_returnflag WHEN 'A' THEN 'bid' WHEN 'R' THEN 'Taker-Sell' ELSE 'none' END AS side,
         CASE WHEN l_tax = 0 THEN NULL WHEN l_tax < 0.015 THEN 'nan' ELSE md5(CAST(l_orderkey AS VARCHAR)) END AS id
  FROM lineitem)"""
FILL_FROM, FILL_TO = 788_918_400_000_000_000, 946_684_800_000_000_000  # 1995..1999 inclusive


def onchain_rows(t: Tables):
    tenths = F.round(F.col("l_discount") * 100).cast("int")
    text = F.format_string("%d.%02d", (tenths / 10).cast("int"), tenths % 10 * 10)
    return t.read("lineitem").select(
        F.col("l_partkey").alias("token"),
        nanos("l_shipdate").alias("timestamp_ns"),
        F.format_string("%012d-%d-%06d-%06d", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("pos"),
        F.when(F.col("l_linenumber") == 7, "bad").otherwise(text).alias("price"),
        F.col("l_quantity").cast("int").cast("string").alias("size"),
        F.when(F.col("l_returnflag") == "A", "bid")
        .when(F.col("l_returnflag") == "R", "Taker-Sell")
        .otherwise("none")
        .alias("side"),
        F.when(F.col("l_tax") == 0, F.lit(None).cast("string"))
        .when(F.col("l_tax") < 0.015, "nan")
        .otherwise(F.md5(F.col("l_orderkey").cast("string")))
        .alias("id"),
    )


@query(
    "onchain_fills",
    "N8",
    f"""WITH {ONCHAIN},
    usable AS (
      SELECT *, coalesce(CASE WHEN id = 'nan' THEN NULL ELSE id END, 'telonex-' || timestamp_ns) AS raw_id
      FROM onchain
      WHERE timestamp_ns BETWEEN {FILL_FROM} AND {FILL_TO}
        AND TRY_CAST(price AS DOUBLE) > 0 AND TRY_CAST(price AS DOUBLE) < 1 AND TRY_CAST(size AS DOUBLE) > 0)
    SELECT token, CAST(price AS DOUBLE) AS price, CAST(size AS DOUBLE) AS size,
           CASE WHEN replace(lower(side), '-', '_') IN ({_words(BUY_WORDS)}) THEN 1
                WHEN replace(lower(side), '-', '_') IN ({_words(SELL_WORDS)}) THEN 2 ELSE 0 END AS aggressor_side,
           right(raw_id, 24) || '-' || printf('%06d', row_number() OVER (PARTITION BY token, raw_id ORDER BY timestamp_ns, pos) - 1) AS trade_id,
           timestamp_ns + least(row_number() OVER (PARTITION BY token, timestamp_ns ORDER BY pos) - 1, 999) AS ts_event
    FROM usable""",
)
def _onchain(t: Tables):
    return trades.onchain_fills(onchain_rows(t), token="token", start=FILL_FROM, end=FILL_TO, width=FILL_WIDTH)


# ---------------------------------------------------------------- exchange trades and bars

@query(
    "exchange_trades",
    "N10 N11",
    """WITH raw AS (
      SELECT 'T' || l_suppkey AS ticker, epoch_us(l_shipdate) * 1000 AS ts_ns,
             printf('%012d-%d-%06d-%06d', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS pos,
             CASE WHEN l_linenumber = 1 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)
                  WHEN l_linenumber = 2 THEN '1.0' WHEN l_linenumber = 3 THEN '150'
                  ELSE printf('0.%02d', CAST(l_quantity AS INTEGER)) END AS yes_price,
             CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS count,
             CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'R' THEN 'no' ELSE '' END AS taker_side,
             'id' || l_orderkey AS trade_id
      FROM lineitem),
    valued AS (
      SELECT *, row_number() OVER (PARTITION BY ticker, ts_ns ORDER BY pos) - 1 AS tie,
             CASE WHEN CAST(yes_price AS DOUBLE) < 1 OR (CAST(yes_price AS DOUBLE) = 1 AND contains(yes_price, '.'))
                  THEN CAST(yes_price AS DOUBLE) ELSE CAST(yes_price AS DOUBLE) / 100 END AS price
      FROM raw)
    SELECT ticker, price, CAST(count AS DOUBLE) AS size,
           CASE taker_side WHEN 'yes' THEN 1 WHEN 'no' THEN 2 ELSE 0 END AS aggressor_side, trade_id,
           ts_ns + least(tie, 999999999 - ts_ns % 1000000000) AS ts_event
    FROM valued WHERE price BETWEEN 0 AND 1""",
)
def _exchange(t: Tables):
    q = F.col("l_quantity").cast("int")
    rows = t.read("lineitem").select(
        F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("ticker"),
        nanos("l_shipdate").alias("ts_ns"),
        F.format_string("%012d-%d-%06d-%06d", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("pos"),
        F.when(F.col("l_linenumber") == 1, q.cast("string"))
        .when(F.col("l_linenumber") == 2, "1.0")
        .when(F.col("l_linenumber") == 3, "150")
        .otherwise(F.format_string("0.%02d", q))
        .alias("yes_price"),
        q.cast("string").alias("count"),
        F.when(F.col("l_returnflag") == "A", "yes").when(F.col("l_returnflag") == "R", "no").otherwise("").alias("taker_side"),
        F.concat(F.lit("id"), F.col("l_orderkey").cast("string")).alias("trade_id"),
    )
    return trades.exchange_trades(rows, width=FILL_WIDTH, fallback_ids=False)


@query(
    "candle_bars",
    "N12",
    f"""WITH {TICKS},
    candles AS (
      SELECT user_id, (ts_ns // {DAY_NS} + 1) * 86400 AS end_s,
             min_by(price, ts_ns) FILTER (WHERE side = 'BUY') AS open, max(price) FILTER (WHERE side = 'BUY') AS high,
             min(price) FILTER (WHERE side = 'BUY') AS low, max_by(price, ts_ns) FILTER (WHERE side = 'BUY') AS close,
             CAST(sum(size) AS BIGINT) AS volume
      FROM ticks GROUP BY 1, 2)
    SELECT user_id, open, high, low, close, volume, end_s * 1000000000 AS ts_event FROM candles
    WHERE open IS NOT NULL""",
)
def _bars(t: Tables):
    bought = F.when(F.col("side") == "BUY", F.col("price"))
    at = F.when(F.col("side") == "BUY", F.struct("ts_ns", "event_id"))
    candles = t.ticks.groupBy(
        "user_id", ((F.floor(F.col("ts_ns") / DAY_NS) + 1) * 86400).alias("end_s")
    ).agg(
        F.min_by("price", at).alias("open"),
        F.max(bought).alias("high"),
        F.min(bought).alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("size").alias("volume"),
    )
    return trades.candles_to_bars(candles, end_s="end_s", volume="volume")


@query(
    "venue_availability",
    "N13",
    f"""WITH {TICKS}
    SELECT event_id, user_id AS instrument, price, size AS quantity, ts_ns AS source_ts_ns,
           greatest(ts_ns + 250000000, CASE WHEN event_id % 3 = 0 THEN ts_ns + event_id % 7 * 100000000 END) AS available_ts_ns
    FROM ticks WHERE side IN ('BUY', 'SELL')""",
)
def _availability(t: Tables):
    rows = t.ticks.filter(F.col("side").isin("BUY", "SELL")).select(
        "event_id",
        F.col("user_id").alias("instrument"),
        "price",
        F.col("size").alias("quantity"),
        F.col("ts_ns").alias("source_ts_ns"),
        F.when(F.col("event_id") % 3 == 0, F.col("ts_ns") + F.col("event_id") % 7 * 100_000_000).alias("receive"),
    )
    return trades.with_availability(
        rows, source_ts="source_ts_ns", receive_ts="receive", delay_ns=250_000_000
    ).drop("receive")


# ---------------------------------------------------------------- raw L2 rows

L2 = f"""{TICKS},
l2 AS (
  SELECT user_id AS asset_id, event_id AS pos, ts_ns AS timestamp_ns, ts_ns + event_id % 3 * 1000 AS received,
         CASE event_type WHEN 'view' THEN 'book' WHEN 'error' THEN 'last_trade_price' ELSE 'price_change' END AS kind,
         size AS k, 10 + size % 60 AS b, event_type
  FROM ticks),
ranked AS (
  SELECT *, CASE WHEN kind = 'book' THEN 0 ELSE 1 END AS rank,
         coalesce(max(CASE WHEN kind = 'book' THEN 1 ELSE 0 END) OVER (
           PARTITION BY asset_id ORDER BY received, CASE WHEN kind = 'book' THEN 0 ELSE 1 END, pos), 0) AS seen
  FROM l2 WHERE kind <> 'last_trade_price'),
emitted AS (
  SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY received, rank, pos) - 1 AS event_index
  FROM ranked WHERE received BETWEEN {START} AND {END} AND seen = 1),
deltas AS (
  SELECT asset_id, event_index, 0 AS part, 4 AS action, 0 AS side, 0.0 AS price, 0.0 AS size, 0 AS flags, timestamp_ns, received
  FROM emitted WHERE kind = 'book'
  UNION ALL
  SELECT asset_id, event_index, i, 1, 1, CAST(printf('0.%02d', b - i) AS DOUBLE), (k + i) % 5 + 1, 0, timestamp_ns, received
  FROM emitted, (SELECT unnest([1, 2, 3]) AS i) WHERE kind = 'book'
  UNION ALL
  SELECT asset_id, event_index, 3 + i, 1, 2, CAST(printf('0.%02d', b + i) AS DOUBLE), (k + i) % 7 + 1,
         CASE WHEN i = 2 THEN 128 ELSE 0 END, timestamp_ns, received
  FROM emitted, (SELECT unnest([1, 2]) AS i) WHERE kind = 'book'
  UNION ALL
  SELECT asset_id, event_index, 0, CASE WHEN k % 5 > 0 THEN 2 ELSE 3 END, CASE WHEN event_type = 'click' THEN 1 ELSE 2 END,
         CAST(printf('0.%02d', CASE WHEN event_type = 'click' THEN b - 1 ELSE b + 1 END) AS DOUBLE), k % 5, 128, timestamp_ns, received
  FROM emitted WHERE kind = 'price_change')"""


def l2_rows(t: Tables):
    k, b = F.col("size"), F.lit(10) + F.col("size") % 60
    lvl = lambda sign, i, mod: [b + sign * i, (k + i) % mod + 1]
    bids = F.format_string('[["0.%02d","%d"],["0.%02d","%d"],["0.%02d","%d"]]', *lvl(-1, 1, 5), *lvl(-1, 2, 5), *lvl(-1, 3, 5))
    asks = F.format_string('[["0.%02d","%d"],["0.%02d","%d"]]', *lvl(1, 1, 7), *lvl(1, 2, 7))
    is_book = F.col("event_type") == "view"
    is_click = F.col("event_type") == "click"
    return t.ticks.select(
        F.col("user_id").alias("asset_id"),
        F.col("event_id").alias("pos"),
        F.col("ts_ns").alias("timestamp_ns"),
        (F.col("ts_ns") + F.col("event_id") % 3 * 1000).alias("timestamp_received_ns"),
        F.when(is_book, "book")
        .when(F.col("event_type") == "error", "last_trade_price")
        .otherwise("price_change")
        .alias("event_type"),
        F.when(is_book, bids).alias("bids"),
        F.when(is_book, asks).alias("asks"),
        F.format_string("0.%02d", F.when(is_click, b - 1).otherwise(b + 1)).alias("price"),
        (k % 5).cast("string").alias("size"),
        F.when(is_click, "BUY").otherwise("SELL").alias("side"),
        F.format_string("tx%d", "event_id").alias("transaction_hash"),
    )


def l2_deltas(t: Tables):
    return books.l2_deltas(l2_rows(t), start=START, end=END, width=TICK_CHUNK)


@query(
    "l2_deltas",
    "N1 N3 S1",
    f"""WITH {L2} SELECT asset_id, event_index, CAST(part AS INTEGER) AS part, action, side, CAST(price AS DOUBLE) AS price,
    CAST(size AS DOUBLE) AS size, flags, timestamp_ns AS ts_event, received AS ts_init FROM deltas""",
)
def _deltas(t: Tables):
    return l2_deltas(t).drop("sequence")


@query(
    "l2_payload_deltas",
    "N2 S2",
    f"""WITH {L2} SELECT asset_id, event_index, CAST(part AS INTEGER) AS part, action, side, CAST(price AS DOUBLE) AS price,
    CAST(size AS DOUBLE) AS size, flags, timestamp_ns AS ts_event, received AS ts_init FROM deltas""",
)
def _payload(t: Tables):
    rows = l2_rows(t)
    secs = F.format_string(
        "%d.%09d", (F.col("timestamp_ns") / 1_000_000_000).cast("bigint"), F.pmod("timestamp_ns", F.lit(1_000_000_000))
    )
    doc = F.concat(
        F.lit('{"token_id":"'), F.col("asset_id").cast("string"), F.lit('","timestamp":'), secs,
        F.when(
            F.col("event_type") == "book",
            F.concat(F.lit(',"bids":'), F.col("bids"), F.lit(',"asks":'), F.col("asks")),
        ).otherwise(
            F.concat(
                F.lit(',"change_price":"'), F.col("price"), F.lit('","change_size":"'), F.col("size"),
                F.lit('","change_side":"'), F.col("side"), F.lit('"'),
            )
        ),
        F.lit("}"),
    )
    raw = rows.select("pos", "timestamp_received_ns", "event_type", doc.alias("data"))
    fixed = books.payload_to_fixed(raw)
    return (
        books.l2_deltas(fixed, start=START, end=END, width=TICK_CHUNK)
        .drop("sequence")
        .withColumn("asset_id", F.col("asset_id").cast("bigint"))
    )


@query(
    "top_of_book",
    "F13 F2",
    f"""WITH {L2},
    last_clear AS (
      SELECT e.asset_id, e.event_index, coalesce(max(d.event_index), -1) AS clear_index
      FROM emitted e LEFT JOIN deltas d ON d.asset_id = e.asset_id AND d.action = 4 AND d.event_index <= e.event_index
      GROUP BY 1, 2),
    alive AS (
      SELECT c.asset_id, c.event_index, d.side, d.price, max_by(d.size, d.event_index * 100 + d.part) AS size
      FROM last_clear c JOIN deltas d ON d.asset_id = c.asset_id AND d.action <> 4 AND d.event_index <= c.event_index
           AND d.event_index >= c.clear_index
      GROUP BY 1, 2, 3, 4),
    best AS (
      SELECT asset_id, event_index, max(price) FILTER (WHERE side = 1) AS bid, min(price) FILTER (WHERE side = 2) AS ask,
             max_by(size, price) FILTER (WHERE side = 1) AS bid_size, min_by(size, price) FILTER (WHERE side = 2) AS ask_size
      FROM alive WHERE size > 0 GROUP BY 1, 2)
    SELECT b.asset_id, b.event_index, e.timestamp_ns AS ts_event, bid, ask, CAST(bid_size AS DOUBLE) AS bid_size,
           CAST(ask_size AS DOUBLE) AS ask_size, (bid_size - ask_size) / (bid_size + ask_size) AS book_imbalance,
           (ask * bid_size + bid * ask_size) / (bid_size + ask_size) / ((bid + ask) / 2) - 1 AS microprice_distance,
           (ask - bid) / ((bid + ask) / 2) * 10000 AS spread_bps
    FROM best b JOIN emitted e USING (asset_id, event_index) WHERE bid < ask""",
)
def _tops(t: Tables):
    tops = books.top_of_book(settle(l2_deltas(t)), token="asset_id", events_per_chunk=1_000, keep=["ts_event"])
    return tops.withColumns(books.book_measures("bid", "ask", "bid_size", "ask_size"))


@query(
    "last_trade_ticks",
    "N9",
    f"""WITH {L2} SELECT asset_id, CAST(printf('0.%02d', b + 1) AS DOUBLE) AS price, CAST(k % 5 AS DOUBLE) AS size, 2 AS aggressor_side,
    'pmxt' || left(sha256('tx' || pos || ':' || asset_id || ':' || timestamp_ns || ':' || received || ':' || pos), 32) AS trade_id,
    timestamp_ns AS ts_event, received AS ts_init
    FROM l2 WHERE kind = 'last_trade_price' AND received BETWEEN {START} AND {END} AND k % 5 > 0""",
)
def _last_trades(t: Tables):
    return trades.last_trade_ticks(l2_rows(t), start=START, end=END)


# ---------------------------------------------------------------- snapshot differences

SNAPSHOTS = f"""{TICKS},
snaps AS (
  SELECT user_id AS token, ts_ns, event_id, size AS k, 10 + size % 6 AS b,
         row_number() OVER (PARTITION BY user_id ORDER BY ts_ns, event_id) AS n
  FROM ticks WHERE event_type IN ('view', 'purchase', 'click') AND ts_ns <= {END}),
raw_levels AS (
  SELECT token, n, ts_ns, 1 AS side, printf('0.%02d', b - i) AS text, (k + i) % 3 AS size FROM snaps, (SELECT unnest([1, 2, 3]) AS i)
  UNION ALL
  SELECT token, n, ts_ns, 2, printf('0.%02d', b + i), (k * i) % 4 FROM snaps, (SELECT unnest([1, 2, 3]) AS i)),
levels AS (SELECT * FROM raw_levels WHERE size > 0),
first_shown AS (SELECT token, min(n) AS first_n FROM levels WHERE ts_ns >= {START} GROUP BY 1),
initial AS (
  SELECT l.token, l.n, l.side, l.text, l.size, 1 AS action FROM levels l JOIN first_shown f ON l.token = f.token AND l.n = f.first_n),
later AS (SELECT s.* FROM snaps s JOIN first_shown f ON s.token = f.token AND s.n > f.first_n),
now_levels AS (SELECT l.* FROM levels l JOIN later s ON l.token = s.token AND l.n = s.n),
prev_levels AS (SELECT s.token, s.n, l.side, l.text, l.size FROM levels l JOIN later s ON l.token = s.token AND l.n = s.n - 1),
changed AS (
  SELECT coalesce(c.token, p.token) AS token, coalesce(c.n, p.n) AS n, coalesce(c.side, p.side) AS side,
         coalesce(c.text, p.text) AS text, coalesce(c.size, 0) AS size, CASE WHEN c.size IS NULL THEN 3 ELSE 2 END AS action
  FROM now_levels c FULL JOIN prev_levels p ON c.token = p.token AND c.n = p.n AND c.side = p.side AND c.text = p.text
  WHERE c.size IS DISTINCT FROM p.size),
everything AS (SELECT * FROM initial UNION ALL SELECT * FROM changed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY token, n ORDER BY side, CASE WHEN side = 1 THEN CAST(text AS DOUBLE) ELSE -CAST(text AS DOUBLE) END) AS i,
         count(*) OVER (PARTITION BY token, n) AS n_rows,
         dense_rank() OVER (PARTITION BY token ORDER BY n) - 1 AS event_index
  FROM everything),
diffs AS (
  SELECT token, n, event_index, action, side, CAST(text AS DOUBLE) AS price, CAST(size AS DOUBLE) AS size,
         CASE WHEN i = n_rows THEN 128 ELSE 0 END AS flags, CAST(CASE WHEN action = 1 THEN 0 ELSE i END AS INTEGER) AS sequence
  FROM placed
  UNION ALL
  SELECT token, n, event_index, 4, 0, 0.0, 0.0, 0, 0 FROM placed WHERE action = 1 AND i = 1)"""

DIFF_SELECT = """SELECT d.token, d.event_index, d.action, d.side, d.price, d.size, d.flags, d.sequence, s.ts_ns AS ts_event
    FROM diffs d JOIN snaps s ON d.token = s.token AND d.n = s.n"""


def snapshots(t: Tables, nested: bool = False):
    k, b = F.col("size"), F.lit(10) + F.col("size") % 6
    text = lambda v: F.format_string("0.%02d", v)
    bid = [(text(b - i), ((k + i) % 3).cast("string")) for i in (1, 2, 3)]
    ask = [(text(b + i), ((k * i) % 4).cast("string")) for i in (1, 2, 3)]
    base = t.ticks.filter(F.col("event_type").isin("view", "purchase", "click"))
    keys = [F.col("user_id").alias("token"), F.col("ts_ns").alias("timestamp_ns"), F.col("event_id").alias("pos")]
    if nested:
        pack = lambda side: F.array(*[F.struct(p.alias("price"), s.alias("size")) for p, s in side])
        return base.select(*keys, pack(bid).alias("bids"), pack(ask).alias("asks"))
    return base.select(
        *keys,
        F.array(*[p for p, _ in bid]).alias("bid_prices"),
        F.array(*[s for _, s in bid]).alias("bid_sizes"),
        F.array(*[p for p, _ in ask]).alias("ask_prices"),
        F.array(*[s for _, s in ask]).alias("ask_sizes"),
    )


@query("snapshot_diffs", "N4", f"WITH {SNAPSHOTS} {DIFF_SELECT}")
def _diffs(t: Tables):
    return books.snapshot_diffs(snapshots(t), token="token", start=START, end=END, width=TICK_CHUNK).drop("ts_init", "part")


@query("nested_snapshot_diffs", "N5", f"WITH {SNAPSHOTS} {DIFF_SELECT}")
def _nested(t: Tables):
    flat = books.nested_to_flat(snapshots(t, nested=True))
    return books.snapshot_diffs(flat, token="token", start=START, end=END, width=TICK_CHUNK).drop("ts_init", "part")


@query(
    "replay_order",
    "J5",
    f"""WITH {TICKS},
    merged AS (
      SELECT user_id, 0 AS priority, ts_ns // 3600000000000 AS ts_event, ts_ns AS ts_init, event_id AS pos FROM ticks WHERE event_type = 'view'
      UNION ALL
      SELECT user_id, 1, ts_ns // 3600000000000, ts_ns, event_id FROM ticks WHERE side IN ('BUY', 'SELL'))
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_event, priority, ts_init, pos) - 1 AS replay_pos FROM merged""",
)
def _replay(t: Tables):
    rows = t.ticks.select(
        "user_id", F.floor(F.col("ts_ns") / 3_600_000_000_000).alias("ts_event"), F.col("ts_ns").alias("ts_init"),
        F.col("event_id").alias("pos"), "event_type", "side",
    )
    view = rows.filter("event_type = 'view'").drop("event_type", "side")
    prints = rows.filter("side IN ('BUY', 'SELL')").drop("event_type", "side")
    return trades.replay_order(view, prints, key="user_id", width=24)
