"""Scans of raw rows, partitioned stores, schema merging, manifests and text formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddsloom.functions.integers import floor_div
from oddsloom.session import DAY_NS, HOUR_NS, settle

L2_EVENTS = ("book", "price_change", "last_trade_price")


# ---------------------------------------------------------------- scans

def scan_l2(df: DataFrame, *, market: str | bytes, token: str | None = None) -> DataFrame:
    """One market's book and trade rows. Compares the stored column with a literal of its own type,
    so that the filter reaches the parquet scan; a binary column is not decoded for it."""
    binary = dict(df.dtypes).get("market") == "binary"
    wanted = market.encode() if binary and isinstance(market, str) else market
    out = df.filter((F.col("market") == F.lit(wanted)) & F.col("event_type").isin(*L2_EVENTS))
    return out if token is None else out.filter(F.col("asset_id") == token)


def scan_payload(df: DataFrame, *, market: str, token: str | None = None) -> DataFrame:
    """The same for JSON-payload rows; the token is compared as a field, not by pattern."""
    out = df.filter((F.col("market_id") == market) & F.col("update_type").isin("book_snapshot", "price_change"))
    return out if token is None else out.filter(F.get_json_object("data", "$.token_id") == token)


def scan_requests(df: DataFrame, requests: DataFrame, *, keys: Sequence[str] = ("market", "asset_id")) -> DataFrame:
    """One pass over the rows for many (market, token) requests; Spark broadcasts them if small."""
    return df.join(requests.select(*keys).distinct(), list(keys), "left_semi")


def archive_hours(start: Column, end: Column) -> Column:
    """Start of each archive hour of a window, with the hour before it for the opening snapshot."""
    hours = F.sequence(floor_div(start, HOUR_NS) - 1, floor_div(end, HOUR_NS))
    return F.when(end > start, F.transform(hours, lambda h: h * F.lit(HOUR_NS))).otherwise(F.array().cast("array<bigint>"))


def source_days(start: Column, end: Column, *, inclusive: bool = False) -> Column:
    """UTC days a window touches; a half-open window leaves out its end instant."""
    last = end if inclusive else end - 1
    days = F.sequence(floor_div(start, DAY_NS), floor_div(last, DAY_NS))
    return F.when(last >= start, days).otherwise(F.array().cast("array<bigint>"))


def to_nanos(ts: Column, unit: str) -> Column:
    """Epoch numbers in s, ms, us or ns as nanoseconds."""
    factor = {"s": 1_000_000_000, "ms": 1_000_000, "us": 1_000, "ns": 1}[unit]
    return ts.cast("bigint") * F.lit(factor)


# ---------------------------------------------------------------- partitioned store

STORE_PARTITIONS = ("channel", "year", "month")


def write_store(df: DataFrame, path: str, *, channel: str, ts_ns: str, slug: str, segment: str, mode: str = "append") -> None:
    """Append to the monthly store, sorted by (slug, segment, time) inside files.

    Range partitioning on (month, slug, segment, time) spreads a hot slug over several tasks and
    keeps files of one month together.
    """
    stamp = F.timestamp_micros(floor_div(ts_ns, 1000))
    keyed = df.withColumns(
        {"channel": F.col(channel), "year": F.year(stamp), "month": F.month(stamp), "day": floor_div(ts_ns, DAY_NS)}
    )
    order = ["channel", "year", "month", slug, segment, ts_ns]
    (
        keyed.repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .write.mode(mode)
        .option("compression", "zstd")
        .partitionBy(*STORE_PARTITIONS)
        .parquet(path)
    )


def read_store(
    spark: SparkSession, path: str, *, channel: str, start_ns: int, end_ns: int, ts_ns: str, slug: str | None = None
) -> DataFrame:
    """Rows of a channel inside [start, end]; year and month predicates prune the partitions."""
    from datetime import UTC, datetime

    def month_of(ns: int) -> int:
        at = datetime.fromtimestamp(ns // 1_000_000_000, UTC)
        return at.year * 12 + at.month - 1

    first, last = month_of(start_ns), month_of(end_ns)
    month_no = F.col("year") * 12 + F.col("month") - 1
    out = spark.read.parquet(path).filter(
        (F.col("channel") == channel)
        & F.col("year").between(first // 12, last // 12)
        & month_no.between(first, last)
        & F.col(ts_ns).between(start_ns, end_ns)
    )
    return out if slug is None else out.filter(F.col("slug") == slug)


def merged_schema(base: T.StructType, incoming: T.StructType) -> T.StructType:
    """Union of the columns; a type may only replace the null type, anything else is refused."""
    new = {f.name: f for f in incoming.fields}
    fields = []
    for f in base.fields:
        g = new.pop(f.name, None)
        if g is None or g.dataType == f.dataType or isinstance(g.dataType, T.NullType):
            fields.append(f)
        elif isinstance(f.dataType, T.NullType):
            fields.append(g)
        else:
            raise ValueError(f"column {f.name} changes from {f.dataType.simpleString()} to {g.dataType.simpleString()}")
    return T.StructType([*fields, *new.values()])


def append_aligned(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """Union by name after the schema guard; missing columns are NULL."""
    target = merged_schema(base.schema, incoming.schema)

    def align(df: DataFrame) -> DataFrame:
        have = set(df.columns)
        return df.select(
            *[
                (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in target.fields
            ]
        )

    return align(base).unionByName(align(incoming))


RAW_PARTITIONS = ("source", "instrument", "date", "hour", "schema_version", "ingest_version")


def with_raw_partitions(events: DataFrame, *, available: str = "available_ts_ns") -> DataFrame:
    stamp = F.timestamp_micros(floor_div(available, 1000))
    return events.withColumns({"date": F.date_format(stamp, "yyyy-MM-dd"), "hour": F.date_format(stamp, "HH")})


def write_raw(events: DataFrame, path: str, *, available: str = "available_ts_ns", sequence: str = "sequence_or_hash") -> None:
    """Raw events by source, instrument, date and hour of availability and versions."""
    keyed = with_raw_partitions(events, available=available)
    order = [*RAW_PARTITIONS, available, sequence]
    (
        keyed.repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .write.mode("append")
        .option("compression", "zstd")
        .partitionBy(*RAW_PARTITIONS)
        .parquet(path)
    )


def read_raw(
    spark: SparkSession, path: str, *, source: str, instrument: str, ingest_version: str, start_ns: int, end_ns: int,
    available: str = "available_ts_ns",
) -> DataFrame:
    """Exact-version rows available inside the window. A row without times or payload, or available
    before its source time, fails the job."""
    out = spark.read.parquet(path).filter(
        (F.col("source") == source)
        & (F.col("instrument") == instrument)
        & (F.col("ingest_version") == ingest_version)
        & F.col(available).between(start_ns, end_ns)
    )
    sound = (
        F.col("source_ts_ns").isNotNull()
        & F.col("payload_json").isNotNull()
        & (F.col(available) >= F.col("source_ts_ns"))
        & (F.col("collector_receive_ts_ns").isNull() | (F.col(available) >= F.col("collector_receive_ts_ns")))
    )
    checked = F.when(sound, F.col(available)).otherwise(F.raise_error(F.lit("malformed raw event")).cast("bigint"))
    return out.withColumn(available, checked)


def manifest(df: DataFrame, *, keys: Sequence[str], ts: str, duplicate: Column | None = None, gap: Column | None = None) -> DataFrame:
    """Row count and time bounds per partition, with duplicate and gap counts if their marks are given."""
    made = [F.count(F.lit(1)).alias("rows"), F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts")]
    if duplicate is not None:
        made.append(F.count_if(duplicate).alias("duplicate_count"))
    if gap is not None:
        made.append(F.count_if(gap).alias("gap_count"))
    return df.groupBy(*keys).agg(*made)


# ---------------------------------------------------------------- text formats

KLINE_SCHEMA = (
    "open_time bigint, open double, high double, low double, close double, volume double, close_time bigint, "
    "quote_volume double, trades bigint, taker_buy_volume double, taker_buy_quote_volume double, unused string"
)


def read_kline_csv(spark: SparkSession, path: str, *, unit: str = "ms", keys: Sequence[str] = ()) -> DataFrame:
    """Kline archives; every row of a repeated open time is dropped, not just the repeats."""
    raw = spark.read.schema(KLINE_SCHEMA).option("mode", "FAILFAST").csv(path)
    if "symbol" in keys:
        raw = raw.withColumn("symbol", F.regexp_extract(F.input_file_name(), "symbol=([^/]+)/", 1))
    kept = F.struct("close", "volume", "quote_volume", "taker_buy_volume")
    return (
        raw.groupBy(*keys, to_nanos(F.col("open_time"), unit).alias("open_ts_ns"))
        .agg(F.count(F.lit(1)).alias("n"), F.first(kept).alias("k"))
        .filter("n = 1")
        .select(*keys, "open_ts_ns", "k.*")
    )


def price_history(payloads: DataFrame, *, column: str) -> DataFrame:
    """{"history": {token: [{"t": s, "p": price}]}} documents to one row per point."""
    doc = F.from_json(F.col(column), "history map<string, array<struct<t: bigint, p: double>>>")
    return (
        payloads.select(F.explode(doc["history"]).alias("token_id", "points"))
        .select("token_id", F.explode("points").alias("x"))
        .select("token_id", F.col("x.t").alias("ts_seconds"), F.col("x.p").alias("price"))
    )


def write_table_csv(df: DataFrame, path: str) -> None:
    """A report table with a header; nested columns as JSON text."""
    flat = df.select(
        *[
            F.to_json(c).alias(c) if d.startswith(("struct", "array", "map")) else F.col(c)
            for c, d in df.dtypes
        ]
    )
    flat.write.mode("overwrite").option("header", "true").csv(path)


def write_catalog_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_catalog_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def group_stride(df: DataFrame, *, group: str, stride: int, order: str | None = None) -> DataFrame:
    """Every stride-th group, whole, in order of its least `order` value, then name. The first is kept.

    Groups are dealt out in ranges of that order and written; a group's number is its place in its
    range behind the sizes of the ranges before, one count per range."""
    lead = F.min(order or group).alias("__lead")
    ranged = df.groupBy(group).agg(lead).repartitionByRange("__lead", group).withColumn("__part", F.spark_partition_id())
    groups = settle(ranged)
    sizes = groups.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    ahead = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__ahead"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy("__lead", group)) - 1
    kept = groups.withColumn("__i", place).join(F.broadcast(ahead), "__part").filter((F.col("__i") + F.col("__ahead")) % stride == 0)
    kept = kept.select(F.col(group).alias("__group"))
    return df.join(kept, df[group].eqNullSafe(kept["__group"]), "left_semi")


READERS = {
    ("l2", "book", "fixed"): scan_l2,
    ("l2", "book", "payload"): scan_payload,
    ("store", "any", "monthly"): read_store,
    ("raw", "any", "events"): read_raw,
    ("archive", "kline", "csv"): read_kline_csv,
    ("archive", "price_history", "json"): price_history,
}


def reader(platform: str, kind: str, vendor: str):
    """Reader registered for (platform, kind, vendor)."""
    try:
        return READERS[(platform, kind, vendor)]
    except KeyError:
        raise KeyError(f"no reader for {platform}/{kind}/{vendor}; known: {sorted(READERS)}") from None
