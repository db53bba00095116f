"""Isotonic regression over ranges against one pass and Spark's own."""

import numpy as np
import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from oddsloom.ml.isotonic import isotonic_blocks, isotonic_value


def sample(seed, n=1500, shape="noisy"):
    rng = np.random.default_rng(seed)
    p = np.round(rng.random(n), 3)
    y = {"noisy": (rng.random(n) < p).astype(float), "falling": 1 - p, "rising": p, "flat": np.full(n, 0.25)}[shape]
    return [(float(a), float(b), float(w)) for a, b, w in zip(p, y, rng.integers(1, 4, n))]


def best(points):
    """Max-min formula: the fitted value of each distinct predictor."""
    xs = sorted({p for p, _, _ in points})
    at = {x: i for i, x in enumerate(xs)}
    s, w = np.zeros(len(xs) + 1), np.zeros(len(xs) + 1)
    for p, y, k in points:
        s[at[p] + 1] += y * k
        w[at[p] + 1] += k
    s, w = np.cumsum(s), np.cumsum(w)
    out = np.full(len(xs), -np.inf)
    for j in range(len(xs)):
        mean = (s[j + 1 :] - s[j]) / (w[j + 1 :] - w[j])
        out[j:] = np.maximum(out[j:], np.minimum.accumulate(mean[::-1])[::-1])
    return dict(zip(xs, out))


@pytest.mark.parametrize("shape", ["noisy", "falling", "rising", "flat"])
@pytest.mark.parametrize("range_rows", [10**6, 90])
def test_blocks_equal_the_max_min_formula(spark, shape, range_rows):
    points = sample(4, shape=shape)
    df = spark.createDataFrame([*points, (None, 1.0, 1.0), (0.5, None, 1.0), (0.5, 1.0, 0.0)], "p double, y double, w double")
    blocks = isotonic_blocks(df, p="p", y="y", weight="w", range_rows=range_rows).orderBy("lo").collect()
    assert all(a.value < b.value and a.hi < b.lo for a, b in zip(blocks, blocks[1:]))
    want = best(points)
    for b in blocks:
        inside = [v for x, v in want.items() if b.lo <= x <= b.hi]
        assert inside and np.allclose(inside, b.value)
    assert sum(b.weight for b in blocks) == sum(w for _, _, w in points)
    assert len(blocks) == len({round(v, 9) for v in want.values()})


def test_values_equal_those_of_spark(spark):
    df = spark.createDataFrame(sample(6), "p double, y double, w double")
    other = spark.createDataFrame([(float(x),) for x in np.linspace(-0.2, 1.2, 200)], "p double")
    got = isotonic_value(other, isotonic_blocks(df, p="p", y="y", weight="w", range_rows=200), p="p", out="q").orderBy("p").toPandas()
    want = IsotonicRegression(featuresCol="p", labelCol="y", weightCol="w").fit(df).setPredictionCol("q").transform(other).orderBy("p").toPandas()
    assert np.allclose(got["q"], want["q"], atol=1e-9)
    assert isotonic_value(df.withColumn("q", F.lit(1)), isotonic_blocks(df, p="p", y="y", weight="w"), p="p", out="q").columns == ["p", "y", "w", "q"]


def test_rows_of_one_predictor_are_looked_up_once(spark, monkeypatch):
    from oddsloom.ml import isotonic

    asked, plain = [], isotonic.asof_backward
    monkeypatch.setattr(isotonic, "asof_backward", lambda left, *a: asked.append(left.count()) or plain(left, *a))
    df = spark.createDataFrame([(k % 3 / 4, float(k % 2), 1.0) for k in range(300)] + [(None, 1.0, 1.0)], "p double, y double, w double")
    out = isotonic_value(df, isotonic_blocks(df, p="p", y="y", weight="w"), p="p", out="q")
    assert asked == [3] and out.count() == 301 and out.filter("p IS NULL AND q IS NULL").count() == 1
