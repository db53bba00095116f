"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.session import prepare, release, settle

#: ASCII white space, as Java and RE2 patterns both read it.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1_000
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class LlmQuery:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, LlmQuery] = {}


def register(name: str, sql: str | None = None):
    """Register `fn(spark, sf_dir) -> DataFrame` under `name`, with the SQL that checks it."""

    def keep(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            small_batches(spark)
            return fn(prepare(spark), sf_dir)

        build.__name__ = name
        QUERIES[name] = LlmQuery(build, sql)
        return fn

    return keep


def small_batches(spark: SparkSession) -> None:
    """At most `BATCH_ROWS` rows in an Arrow batch: texts are long, and a batch lies in memory several times."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def normalised(text: Column) -> Column:
    """White space runs as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _stars(links: DataFrame) -> bool:
    """Whether links (u, v) are stars: no node points twice, and none that is pointed at points on."""
    ends = links.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(
        links.select(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    nodes = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not nodes.filter((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))).limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b); the component is its smallest node.

    Alternates large-star and small-star steps until every node that points anywhere points at one
    node that points nowhere: the smallest one it can reach. Each step is two aggregations and a join on the node,
    so no neighbourhood is gathered in one place, and each round is a written table. Self edges only
    name their node. The number of rounds grows with the logarithm of the longest path.
    """
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = settle(both)
    alone = state.filter("u = v").select("u").distinct()
    links, table = state.filter("u <> v"), None
    while not _stars(links):
        # Large star: each strictly larger neighbour of u now hangs on the smallest neighbour of u, or u itself.
        ways = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = ways.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # Small star: u and its smaller neighbours hang on the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        links = settle(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        release(*([table] if table else []))
        table = links
    roots = links.select(F.col("v").alias("u")).union(alone).distinct()
    found = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    only = roots.join(links.select("u"), "u", "left_anti")
    return found.union(only.select(F.col("u").alias("node"), F.col("u").alias("component")))


#: Bits of a screen: 512 bitmaps of 4 kB, however many keys there are.
SCREEN_BITS = 1 << 24


def _marked(df: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(SCREEN_BITS)) + 1
    bit = spot(F.col(name))
    maps = keys.groupBy(F.bitmap_bucket_number(bit).alias("__bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("__bits")
    )
    marked = df.withColumn("__spot", spot(key))
    met = marked.join(F.broadcast(maps), F.bitmap_bucket_number("__spot") == F.col("__bucket"), "left")
    place = F.bitmap_bit_position("__spot")
    octet = F.conv(F.hex(F.substring("__bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.withColumn("__may", F.coalesce(F.getbit(octet, (place % 8).cast("int")) == 1, F.lit(False)))


def screened(df: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """The rows of `df` whose `key` may be in the column `name` of `keys`, to thin `df` before an exact join.

    The screen is a bitmap of fixed size, so broadcasting it is safe whatever the number of keys; with very
    many keys it lets more rows through. It never drops a row that the exact join would keep."""
    return _marked(df, key, keys, name).filter("__may").select(*df.columns)


def unscreened(df: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """The rows that `screened` leaves out: their `key` is certainly not among the keys."""
    return _marked(df, key, keys, name).filter("NOT __may").select(*df.columns)


def bitmap(keys: DataFrame, name: str, bits: int) -> bytearray:
    """A bitmap of the low bits of a bigint column. At most `bits` / 32768 rows of 4 kB come to the driver."""
    spot = F.col(name).bitwiseAND(bits - 1) + 1
    maps = keys.groupBy(F.bitmap_bucket_number(spot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits"))
    out = bytearray(bits // 8)
    for bucket, part in maps.collect():
        out[(bucket - 1) * 4096 : (bucket - 1) * 4096 + len(part)] = part
    return out


def in_bitmap(value: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each 64-bit value may be among the keys of a bitmap."""
    spot = value.view(np.uint64) & np.uint64(8 * len(bits) - 1)
    return (bits[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1
