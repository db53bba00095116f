"""Chunked scans against brute force, with hot keys, sparse keys and tiny chunks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oddsloom.operators import timeline as tl
from oddsloom.operators.asof import asof_backward


def data(seed=3, n=600):
    rng = np.random.default_rng(seed)
    # One key holds most of the rows; times collide.
    key = np.where(rng.random(n) < 0.6, 0, rng.integers(1, 6, n))
    return pd.DataFrame(
        {"k": key, "t": rng.integers(-50, 400, n), "i": np.arange(n), "v": np.where(rng.random(n) < 0.3, np.nan, rng.integers(0, 100, n))}
    ).sort_values(["k", "t", "i"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def frame(spark):
    pdf = data()
    sdf = spark.createDataFrame(pdf.sample(frac=1, random_state=1)).withColumn("v", F.nanvl("v", F.lit(None)))
    return pdf, sdf


@pytest.mark.parametrize("width", [7, 100, 10_000, None])
@pytest.mark.parametrize("hot", ["0", "150", "1000000"])
def test_scans_equal_the_plain_window(spark, frame, width, hot):
    """Every key split, only the hot one, and none."""
    spark.conf.set("oddsloom.hotRows", hot)
    try:
        _compare_with_pandas(frame, width)
    finally:
        spark.conf.set("oddsloom.hotRows", "0")


def _compare_with_pandas(frame, width):
    pdf, sdf = frame
    line = tl.Timeline.of("k", ["t", "i"], width)
    v = F.col("v")
    got = (
        tl.scan(
            sdf,
            line,
            {
                "total": tl.running_sum(v), "n": tl.running_count(v > 50), "top": tl.running_max(v), "low": tl.running_min(v),
                "last": tl.latest(v), "first": tl.earliest(v), "prev": tl.previous(F.col("i")), "next": tl.following(F.col("i")),
                "was": tl.before(tl.running_sum(v)), "all_": tl.whole_sum(v), "end": tl.whole_last(v), "start": tl.whole_first(v),
                "most": tl.whole_max(v), "least_": tl.whole_min(v),
            },
        )
        .orderBy("k", "t", "i")
        .toPandas()
    )
    g = pdf.groupby("k")
    filled = pdf.assign(v0=pdf.v.fillna(0), seen=pdf.v.notna())
    has = filled.groupby("k").seen.cumsum() > 0
    want = pd.DataFrame(
        {
            "total": filled.groupby("k").v0.cumsum().where(has),
            "n": (pdf.v > 50).groupby(pdf.k).cumsum(),
            "top": g.v.cummax().groupby(pdf.k).ffill(),
            "low": g.v.cummin().groupby(pdf.k).ffill(),
            "last": g.v.ffill(),
            "prev": g.i.shift(1),
            "next": g.i.shift(-1),
            "all_": g.v.transform("sum"),
            "end": g.v.transform("last"),
            "start": g.v.transform("first"),
            "most": g.v.transform("max"),
            "least_": g.v.transform("min"),
        }
    )
    want["first"] = want["start"].where(has)
    want["was"] = want["total"].groupby(pdf.k).shift(1)
    for c in want:
        np.testing.assert_allclose(
            got[c].astype(float).to_numpy(), want[c].astype(float).to_numpy(), err_msg=f"{c} at width {width}"
        )


def test_positions_and_row_frames(frame):
    pdf, sdf = frame
    placed = tl.number(sdf, tl.Timeline.of("k", ["t", "i"], 13))
    out = tl.row_frames(
        placed, "k", "pos", 5, {"s": lambda w: F.sum("i").over(w.rowsBetween(-5, -1))}, rows_per_chunk=17
    ).orderBy("k", "t", "i").toPandas()
    assert (out.pos == pdf.groupby("k").cumcount()).all()
    want = pdf.groupby("k").i.transform(lambda x: x.shift(1).rolling(5, min_periods=1).sum())
    np.testing.assert_allclose(out.s.astype(float), want.astype(float))


def test_linear_recurrence_over_chunks(spark):
    x = np.random.default_rng(0).random(97)
    pdf = pd.DataFrame({"k": 1, "pos": np.arange(97), "x": x})
    out = tl.linear_recurrence(
        spark.createDataFrame(pdf), "k", "pos", {"y": ("x", 0.3), "z": ("x", 0.05)}, rows_per_chunk=10
    ).orderBy("pos").toPandas()
    np.testing.assert_allclose(out.y, pd.Series(x).ewm(alpha=0.3, adjust=False).mean())
    np.testing.assert_allclose(out.z, pd.Series(x).ewm(alpha=0.05, adjust=False).mean())


def test_quantiles_are_exact(frame):
    pdf, sdf = frame
    out = tl.quantiles(sdf, ["k"], "v", {"a": 0.5, "b": 0.95}, 9.0).orderBy("k").toPandas()
    want = pdf.groupby("k").v.quantile([0.5, 0.95]).unstack()
    np.testing.assert_allclose(out[["a", "b"]].to_numpy(), want.to_numpy())
    whole = tl.quantiles(sdf, [], "v", {"a": 0.25}, 9.0).first()
    assert whole.a == pytest.approx(pdf.v.quantile(0.25))


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("width", [11, 5_000])
def test_asof_equals_merge_asof(frame, spark, strict, width):
    pdf, sdf = frame
    right = pdf[pdf.i % 3 == 0][["k", "t", "i", "v"]].rename(columns={"t": "rt", "i": "ri", "v": "rv"})
    left = pdf[pdf.i % 3 != 0][["k", "t", "i"]]
    out = asof_backward(
        spark.createDataFrame(left), spark.createDataFrame(right), "k", "t", "rt", ["ri"], width, right_tie=["ri"], strict=strict
    ).orderBy("t", "i").toPandas()
    want = pd.merge_asof(
        left.sort_values(["t", "i"]), right.sort_values(["rt", "ri"]), left_on="t", right_on="rt", by="k", allow_exact_matches=not strict
    ).sort_values(["t", "i"])
    np.testing.assert_allclose(out.ri.astype(float).to_numpy(), want.ri.astype(float).to_numpy())


def test_asof_tolerance_mask_and_unmatched_rows(spark, rows):
    left = spark.createDataFrame([(1, 5), (1, 12), (1, 30), (2, 5)], "k int, t bigint")
    right = spark.createDataFrame([(1, 10, "a"), (1, 20, "b")], "k int, rt bigint, x string")
    near = asof_backward(left, right, "k", "t", "rt", ["x"], 8, tolerance=5)
    assert rows(near, "k", "t", "x", order=["k", "t"]) == [(1, 5, None), (1, 12, "a"), (1, 30, None), (2, 5, None)]
    masked = asof_backward(left, right, "k", "t", "rt", ["x"], 8, mask_after_last=True)
    assert rows(masked, "k", "t", "x", order=["k", "t"]) == [(1, 5, None), (1, 12, "a"), (1, 30, None), (2, 5, None)]


def test_results_do_not_depend_on_partitioning(spark, frame):
    _, sdf = frame
    line = tl.Timeline.of("k", ["t", "i"], 20)
    run = lambda: tl.scan(sdf, line, {"s": tl.running_sum(F.col("v"))}).orderBy("k", "t", "i").collect()
    few = run()
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert run() == few
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_hot_key_is_spread_over_partitions(spark):
    """All rows of one key: the shuffle of the scan must not put them into one partition."""
    hot = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    out = tl.scan(hot, tl.Timeline.of("k", "t", 500), {"s": tl.running_count()})
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r.n for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 4 and max(sizes) < 10_000
    assert out.agg(F.max("s")).first()[0] == 20_000
