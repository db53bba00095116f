"""The supplied tables in the roles the operators expect, in Spark and as SQL fragments.

`events` plays ticks, book tops and feeds (minutes and hours stand in for seconds, as it is thin);
`lineitem` and `orders` play fills; `lineitem` discounts play forecasts.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.functions.floats import round_scaled
from oddsloom.session import DAY_NS, NANOS

# Chunk widths for these tables; a real deployment passes its own (see README).
TICK_CHUNK = DAY_NS
FILL_CHUNK = 90 * DAY_NS

TICKS = """ticks AS (
  SELECT user_id, epoch_us(ts) * 1000 AS ts_ns, event_id, event_type, value / 500 AS price,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS size,
         CASE event_type WHEN 'click' THEN 'BUY' WHEN 'purchase' THEN 'SELL' ELSE 'mint' END AS side
  FROM events)"""

FILLS = """fills AS (
  SELECT l_partkey AS market, epoch_us(l_shipdate) * 1000 AS ts_ns, l_orderkey AS order_id,
         l_linenumber AS line_no, l_suppkey AS account,
         CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS action,
         CASE WHEN l_linestatus = 'O' THEN 'yes' ELSE 'no' END AS side,
         round(l_extendedprice / l_quantity / 110000, 4) AS price, l_quantity AS quantity, l_tax AS commission
  FROM lineitem
  WHERE round(l_extendedprice / l_quantity / 110000, 4) > 0 AND round(l_extendedprice / l_quantity / 110000, 4) < 1)"""

FORECASTS = """forecasts AS (
  SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey AS market, epoch_us(l_shipdate) * 1000 AS ts_ns,
         least(1.0, greatest(0.0, l_discount * 10)) AS p_up,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS outcome,
         l_quantity AS weight, l_linestatus AS regime
  FROM lineitem)"""

FILL_ORDER = ["ts_ns", "order_id", "line_no", "market", "account"]


def nanos(column: str):
    """A timestamp without zone as nanoseconds since the epoch."""
    return F.unix_micros(F.col(column).cast("timestamp")) * F.lit(1000)


class Tables:
    """Reads from one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    @cached_property
    def ticks(self) -> DataFrame:
        return self.read("events").select(
            "user_id",
            nanos("ts").alias("ts_ns"),
            "event_id",
            "event_type",
            (F.col("value") / 500).alias("price"),
            F.get_json_object("props", "$.k").cast("int").alias("size"),
            F.when(F.col("event_type") == "click", "BUY")
            .when(F.col("event_type") == "purchase", "SELL")
            .otherwise("mint")
            .alias("side"),
        )

    @cached_property
    def fills(self) -> DataFrame:
        ratio = round_scaled(F.col("l_extendedprice") / F.col("l_quantity") / 110000, 4)
        return (
            self.read("lineitem")
            .filter((ratio > 0) & (ratio < 1))
            .select(
                F.col("l_partkey").alias("market"),
                nanos("l_shipdate").alias("ts_ns"),
                F.col("l_orderkey").alias("order_id"),
                F.col("l_linenumber").alias("line_no"),
                F.col("l_suppkey").alias("account"),
                F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("action"),
                F.when(F.col("l_linestatus") == "O", "yes").otherwise("no").alias("side"),
                ratio.alias("price"),
                F.col("l_quantity").alias("quantity"),
                F.col("l_tax").alias("commission"),
            )
        )

    @cached_property
    def forecasts(self) -> DataFrame:
        return self.read("lineitem").select(
            "l_orderkey",
            "l_linenumber",
            "l_suppkey",
            F.col("l_partkey").alias("market"),
            nanos("l_shipdate").alias("ts_ns"),
            F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("l_discount") * 10)).alias("p_up"),
            F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("outcome"),
            F.col("l_quantity").alias("weight"),
            F.col("l_linestatus").alias("regime"),
        )


__all__ = [
    "DAY_NS", "FILLS", "FILL_CHUNK", "FILL_ORDER", "FORECASTS", "NANOS", "TICKS", "TICK_CHUNK",
    "Tables", "nanos",
]
