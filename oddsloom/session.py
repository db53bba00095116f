"""Session settings and the shared folder for cut points."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NANOS = 1_000_000_000
DAY_NS = 86_400 * NANOS
HOUR_NS = 3_600 * NANOS


def build_session(master: str | None = None, app: str = "oddsloom", **conf: str) -> SparkSession:
    """A session with the settings every operator expects; `conf` overrides win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings results depend on, on a session somebody else built."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Split a hot join partition even where the next step then needs a shuffle of its own.
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a scratch one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", scratch)
    return scratch


def beside(df: DataFrame, single: DataFrame, how: str = "inner") -> DataFrame:
    """Put the one row of a global aggregate next to every row; one row is always safe to broadcast."""
    one = F.lit(0).alias("__one")
    return df.select("*", one).join(F.broadcast(single.select("*", one)), "__one", how).drop("__one")


def settle(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Write `df` to the shared folder and read it back, in a folder for each value of `by` (few; readers of one skip the rest).

    Used between chained scans, so that each stage reads its input once from a table that
    outlives any executor instead of replaying the whole lineage per branch. `release` removes the
    table once nothing will read it any more.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/oddsloom-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.settled_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Remove tables that `settle` wrote. Only for those that no DataFrame still to be run depends on."""
    for table in tables:
        path = getattr(table, "settled_path", None)
        if path:
            jvm = table.sparkSession.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
