"""Scans, stores and text formats, each written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from oddsloom.functions.integers import floor_div, floor_to
from oddsloom.plans.analogs import DAY_NS, FILLS, TICKS, Tables
from oddsloom.plans.market_data import END, START, l2_rows
from oddsloom.plans.registry import query
from oddsloom.session import shared_folder
from oddsloom.sources import store as sr

HOUR = 3_600_000_000_000


def scratch(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark).rstrip('/')}/oddsloom-{name}-{uuid.uuid4().hex}"


@query(
    "scan_requests",
    "S3 S1",
    f"""WITH {TICKS}, r AS (SELECT DISTINCT user_id AS k FROM ticks WHERE event_type = 'signup' AND size > 90)
    SELECT event_id, user_id, ts_ns FROM ticks SEMI JOIN r ON ticks.user_id = r.k WHERE event_type IN ('view', 'click', 'purchase')""",
)
def _requests(t: Tables):
    rows = t.ticks.filter("event_type IN ('view', 'click', 'purchase')").select(
        "event_id", F.col("user_id").alias("market"), F.col("user_id").alias("asset_id"), "ts_ns"
    )
    wanted = t.ticks.filter("event_type = 'signup' AND size > 90").select(
        F.col("user_id").alias("market"), F.col("user_id").alias("asset_id")
    )
    return sr.scan_requests(rows, wanted).select("event_id", F.col("market").alias("user_id"), "ts_ns")


@query(
    "window_hours",
    "S4",
    f"""WITH {TICKS}, w AS (SELECT user_id, min(ts_ns) AS s, min(ts_ns) + (user_id % 30) * {HOUR} AS e FROM ticks GROUP BY 1)
    SELECT user_id, unnest(range(s // {HOUR} - 1, e // {HOUR} + 1)) * {HOUR} AS hour_ns FROM w WHERE e > s""",
)
def _hours(t: Tables):
    w = t.ticks.groupBy("user_id").agg(F.min("ts_ns").alias("s"))
    w = w.withColumn("e", F.col("s") + F.col("user_id") % 30 * HOUR)
    return w.select("user_id", F.explode(sr.archive_hours(F.col("s"), F.col("e"))).alias("hour_ns"))


@query(
    "window_days",
    "S5",
    f"""WITH {TICKS}, w AS (SELECT user_id, min(ts_ns) AS s, (max(ts_ns) // {DAY_NS}) * {DAY_NS} AS e FROM ticks GROUP BY 1)
    SELECT user_id, 'half_open' AS kind, unnest(range(s // {DAY_NS}, (e - 1) // {DAY_NS} + 1)) AS day FROM w WHERE e > s
    UNION ALL SELECT user_id, 'inclusive', unnest(range(s // {DAY_NS}, e // {DAY_NS} + 1)) FROM w WHERE e >= s""",
)
def _days(t: Tables):
    w = t.ticks.groupBy("user_id").agg(F.min("ts_ns").alias("s"), floor_to(F.max("ts_ns"), DAY_NS).alias("e"))
    part = lambda kind, inc: w.select(
        "user_id", F.lit(kind).alias("kind"), F.explode(sr.source_days(F.col("s"), F.col("e"), inclusive=inc)).alias("day")
    )
    return part("half_open", False).unionByName(part("inclusive", True))


STORE_FROM, STORE_TO = 899_251_200_000_000_000, 930_787_200_000_000_000


@query(
    "monthly_store",
    "S6 S7",
    f"""WITH {FILLS} SELECT 'm' || market AS slug, side AS segment, ts_ns, order_id, line_no, account, price FROM fills
    WHERE action = 'buy' AND ts_ns BETWEEN {STORE_FROM} AND {STORE_TO}""",
)
def _store(t: Tables):
    rows = t.fills.select(
        F.concat(F.lit("m"), F.col("market").cast("string")).alias("slug"), F.col("side").alias("segment"), "ts_ns",
        "order_id", "line_no", "account", "price", "action",
    )
    path = scratch(t, "store")
    sr.write_store(rows, path, channel="action", ts_ns="ts_ns", slug="slug", segment="segment")
    out = sr.read_store(t.spark, path, channel="buy", start_ns=STORE_FROM, end_ns=STORE_TO, ts_ns="ts_ns")
    return out.select("slug", "segment", "ts_ns", "order_id", "line_no", "account", "price")


@query(
    "aligned_append",
    "S8",
    f"""WITH {TICKS} SELECT event_id, price, CAST(NULL AS VARCHAR) AS note, size FROM ticks WHERE event_type = 'view'
    UNION ALL SELECT event_id, price, side, CAST(NULL AS INTEGER) FROM ticks WHERE event_type = 'click'""",
)
def _aligned(t: Tables):
    first = t.ticks.filter("event_type = 'view'").select("event_id", "price", F.lit(None).alias("note"), "size")
    second = t.ticks.filter("event_type = 'click'").select("event_id", "price", F.col("side").alias("note"))
    return sr.append_aligned(first, second)


def raw_events(t: Tables):
    # Time runs a hundred times faster here: an hourly partition of the thin table would hold one row.
    ts = floor_div("ts_ns", 100)
    return t.ticks.select(
        ts.alias("source_ts_ns"),
        F.when(F.col("size") % 2 == 0, ts + 5_000_000).alias("collector_receive_ts_ns"),
        (ts + 10_000_000).alias("available_ts_ns"),
        F.col("event_id").cast("string").alias("sequence_or_hash"),
        F.col("event_type").alias("source"),
        F.concat(F.lit("i"), (F.col("user_id") % 3).cast("string")).alias("instrument"),
        F.lit("v1").alias("schema_version"),
        F.when(F.col("event_id") % 5 == 0, "b").otherwise("a").alias("ingest_version"),
        F.floor(F.col("event_id") / 1000).alias("epoch_id"),
        F.to_json(F.struct("price", "size")).alias("payload_json"),
    )


@query(
    "raw_event_store",
    "S9 S11",
    f"""WITH {TICKS} SELECT CAST(event_id AS VARCHAR) AS sequence_or_hash, ts_ns // 100 AS source_ts_ns, ts_ns // 100 + 10000000 AS available_ts_ns FROM ticks
    WHERE event_type = 'click' AND user_id % 3 = 1 AND event_id % 5 <> 0 AND ts_ns // 100 + 10000000 BETWEEN {START // 100} AND {END // 100}""",
)
def _raw(t: Tables):
    path = scratch(t, "raw")
    sr.write_raw(raw_events(t), path)
    out = sr.read_raw(
        t.spark, path, source="click", instrument="i1", ingest_version="a", start_ns=START // 100, end_ns=END // 100
    )
    return out.select("sequence_or_hash", "source_ts_ns", "available_ts_ns")


@query(
    "partition_manifest",
    "S10",
    f"""WITH {TICKS}, d AS (SELECT *, row_number() OVER (PARTITION BY user_id, size ORDER BY event_id) > 1 AS dup FROM ticks)
    SELECT event_type AS source, ts_ns // {DAY_NS} AS day, ts_ns // {HOUR} % 24 AS hour, count(*) AS rows, min(ts_ns) AS min_ts, max(ts_ns) AS max_ts,
           count(*) FILTER (WHERE dup) AS duplicate_count, count(*) FILTER (WHERE size = 0) AS gap_count FROM d GROUP BY 1, 2, 3""",
)
def _manifest(t: Tables):
    from oddsloom.operators.timeline import Timeline, number

    rows = number(t.ticks, Timeline.of(["user_id", "size"], ["event_id"], 5_000), "nth").select(
        F.col("event_type").alias("source"), floor_div("ts_ns", DAY_NS).alias("day"), (floor_div("ts_ns", HOUR) % 24).alias("hour"),
        "ts_ns", "nth", "size",
    )
    return sr.manifest(
        rows, keys=["source", "day", "hour"], ts="ts_ns", duplicate=F.col("nth") > 0, gap=F.col("size") == 0
    )


@query(
    "kline_archive",
    "S12",
    f"""WITH {TICKS}, b AS (SELECT event_type AS symbol, ts_ns // {HOUR} * {HOUR} AS open_ts_ns, price AS close, CAST(size AS DOUBLE) AS volume FROM ticks)
    SELECT symbol, open_ts_ns, any_value(close) AS close, any_value(volume) AS volume FROM b GROUP BY 1, 2 HAVING count(*) = 1""",
)
def _klines(t: Tables):
    path = scratch(t, "klines")
    ms = floor_div("ts_ns", HOUR) * 3_600_000
    price = F.col("price")
    t.ticks.select(
        F.col("event_type").alias("symbol"), ms.alias("open_time"), price.alias("open"), price.alias("high"), price.alias("low"),
        price.alias("close"), F.col("size").cast("double").alias("volume"), (ms + 3_599_999).alias("close_time"),
        price.alias("quote_volume"), F.lit(1).cast("bigint").alias("trades"), price.alias("taker_buy_volume"),
        price.alias("taker_buy_quote_volume"), F.lit("0").alias("unused"),
    ).write.partitionBy("symbol").csv(path)
    out = sr.read_kline_csv(t.spark, path + "/symbol=*", unit="ms", keys=["symbol"])
    return out.select("symbol", "open_ts_ns", "close", "volume")


@query(
    "price_history",
    "S13",
    f"""WITH {TICKS} SELECT CAST(user_id AS VARCHAR) || 'u' AS token_id, ts_ns // 1000000000 AS ts_seconds, price FROM ticks
    UNION ALL SELECT CAST(user_id AS VARCHAR) || 'd', ts_ns // 1000000000 + 1, price FROM ticks""",
)
def _history(t: Tables):
    tok, sec = F.col("user_id").cast("string"), floor_div("ts_ns", 1_000_000_000)
    point = lambda s: F.array(F.struct(s.alias("t"), F.col("price").alias("p")))
    doc = F.to_json(
        F.struct(F.create_map(F.concat(tok, F.lit("u")), point(sec), F.concat(tok, F.lit("d")), point(sec + 1)).alias("history"))
    )
    return sr.price_history(t.ticks.select(doc.alias("payload")), column="payload")


@query(
    "report_csv",
    "S14",
    """SELECT o_custkey AS trial, count(*) AS fills, CAST(max(floor(o_totalprice)) AS BIGINT) AS best, '[' || min(o_orderkey) || ',' || max(o_orderkey) || ']' AS range FROM orders GROUP BY 1""",
)
def _csv(t: Tables):
    path = scratch(t, "report")
    board = t.read("orders").groupBy(F.col("o_custkey").alias("trial")).agg(
        F.count(F.lit(1)).alias("fills"), F.max(F.floor("o_totalprice")).alias("best"),
        F.array(F.min("o_orderkey"), F.max("o_orderkey")).alias("range"),
    )
    sr.write_table_csv(board, path)
    return t.spark.read.schema("trial bigint, fills bigint, best bigint, range string").option("header", "true").csv(path)


@query(
    "catalog_json",
    "S15",
    """SELECT p_partkey AS id, 'slug-' || p_partkey AS slug, CASE WHEN p_size % 2 = 0 THEN p_brand END AS resolution, p_size AS size FROM part""",
)
def _catalog(t: Tables):
    path = scratch(t, "catalog")
    rows = t.read("part").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("slug-"), F.col("p_partkey").cast("string")).alias("slug"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("resolution"), F.col("p_size").alias("size"),
    )
    sr.write_catalog_json(rows, path)
    return sr.read_catalog_json(t.spark, path, rows.schema)


@query(
    "group_stride",
    "S16",
    f"""WITH {TICKS}, g AS (SELECT user_id, row_number() OVER (ORDER BY min(ts_ns), user_id) - 1 AS i FROM ticks GROUP BY 1)
    SELECT event_id, user_id FROM ticks WHERE user_id IN (SELECT user_id FROM g WHERE i % 4 = 0)""",
)
def _stride(t: Tables):
    return sr.group_stride(t.ticks, group="user_id", stride=4, order="ts_ns").select("event_id", "user_id")


@query(
    "market_scan",
    "S1 E5",
    f"""WITH {TICKS} SELECT user_id AS asset_id, event_id AS pos, ts_ns AS timestamp_ns FROM ticks WHERE user_id % 10 = 7""",
)
def _scan(t: Tables):
    scan = sr.reader("l2", "book", "fixed")
    rows = l2_rows(t).withColumn("market", (F.col("asset_id") % 10).cast("string").cast("binary"))
    out = scan(
        rows.withColumn("event_type", F.coalesce("event_type", F.lit("book"))), market="7"
    )
    return out.select("asset_id", "pos", "timestamp_ns")
