"""Tasks of plain windows hold a bounded number of rows, whatever merged partitions weigh."""

import pytest
from pyspark.sql import functions as F

from oddsloom.operators import portfolio as pf
from oddsloom.operators import timeline as tl


@pytest.fixture
def plain(spark, monkeypatch):
    """No key is hot, and few rows are many."""
    was = spark.conf.get("oddsloom.hotRows")
    spark.conf.set("oddsloom.hotRows", "2000000")
    for module in (tl, pf):
        monkeypatch.setattr(module, "MANY_ROWS", 100)
    monkeypatch.setattr(tl, "TASK_ROWS", 50)
    yield
    spark.conf.set("oddsloom.hotRows", was)


def test_a_plain_window_is_dealt_by_rows(spark, plain):
    df = spark.range(900).select((F.col("id") % 90).alias("key"), F.col("id").alias("ts"))
    out = tl.number(df, tl.Timeline.of("key", "ts", 10))
    assert out.rdd.getNumPartitions() == tl.tasks_for(900) == 32
    assert {(r.key, r.ts, r.pos) for r in out.collect()} == {(i % 90, i, i // 90) for i in range(900)}


def test_windows_of_sharpe_are_dealt_by_rows(spark, plain):
    df = spark.range(6_000).select((F.col("id") % 60).alias("key"), F.col("id").alias("ts"), (F.col("id") % 7 + 1.0).alias("price"))
    out = pf.rolling_sharpe(df, key="key", order=["ts"], value="price", width=1_000, median_width=1.0)
    assert tl.tasks_for(6_000) == 128 and ", 128)" in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 6_000
