"""Bootstrap draws: dealt over tasks, and the same days as drawing by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from oddsloom.operators import evaluate


@pytest.mark.parametrize("stretch", [3, 10_000])
def test_draws_of_one_key_are_dealt_over_tasks(spark, monkeypatch, stretch):
    monkeypatch.setattr(evaluate, "DRAWN_SLOTS", stretch)
    days = 7
    daily = spark.createDataFrame([(0, 100 + d, float(d)) for d in range(days)], "k int, __day long, v double")
    rows = evaluate._day_draws(daily, ["k"], 40, 17).select("__b", "__slot", "v", F.spark_partition_id().alias("task")).collect()
    assert len({r.task for r in rows}) > 10
    draw = lambda b, slot: int(hashlib.md5(f"17:{b}:{slot}".encode()).hexdigest()[:8], 16) % days
    assert {(r["__b"], r["__slot"]): r.v for r in rows} == {(b, s): float(draw(b, s)) for b in range(40) for s in range(days)}
    assert len(rows) == 40 * days
