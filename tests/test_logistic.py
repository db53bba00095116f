"""The logistic fit against a dense computation on a small table."""

import math

import numpy as np
import pytest

from oddsloom.ml import direction as md
from oddsloom.ml.logistic import fit_logistic


def sample(n: int = 400, scale: float = 1.0):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 2)) * [scale, 3.0] + [10.0, -2.0]
    w = rng.integers(1, 4, n).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 10) / scale - 0.3 * x[:, 1]))).astype(float)
    return x, y, w


def table(spark, x, y, w):
    return spark.createDataFrame([(*map(float, a), 7.0, float(b), float(c)) for a, b, c in zip(x, y, w)], "a double, b double, same double, y double, w double")


def dense(x, y, w, c):
    """Gradient of C times the weighted loss plus half the squared norm, followed to its root."""
    m = np.average(x, axis=0, weights=w)
    z = np.column_stack([np.ones(len(x)), (x - m) / np.sqrt(np.average((x - m) ** 2, axis=0, weights=w))])
    ridge, beta = np.array([0, 1, 1]) / c, np.zeros(3)
    for _ in range(50):
        mu = 1 / (1 + np.exp(-z @ beta))
        beta += np.linalg.solve((z * (w * mu * (1 - mu))[:, None]).T @ z + np.diag(ridge), z.T @ (w * (y - mu)) - ridge * beta)
    return beta, 1 / (1 + np.exp(-z @ beta))


@pytest.mark.parametrize("c", [1.0, 0.01])
def test_fit_equals_the_dense_one(spark, c):
    x, y, w = sample()
    beta, p = dense(x, y, w, c)
    df = table(spark, x, y, w)
    fit = fit_logistic(df, features=["a", "b"], label="y", weight="w", c=c)
    assert [fit.intercept, *fit.coefficients] == pytest.approx(list(beta), abs=1e-9)
    assert [r.q for r in md.score(fit, df, out="q").select("q").collect()] == pytest.approx(list(p), abs=1e-9)


def test_weights_are_repetitions_and_a_constant_feature_says_nothing(spark):
    x, y, w = sample(120)
    df = table(spark, x, y, w)
    one = fit_logistic(df, features=["a", "same", "b"], label="y", weight="w")
    again = np.repeat(np.arange(len(x)), w.astype(int))
    many = fit_logistic(table(spark, x[again], y[again], np.ones(len(again))), features=["a", "b"], label="y", weight="w")
    assert one.scales[1] == 1.0 and one.coefficients[1] == pytest.approx(0.0, abs=1e-12)
    assert [one.intercept, one.coefficients[0], one.coefficients[2]] == pytest.approx([many.intercept, *many.coefficients], abs=1e-9)


def test_parted_classes_have_a_finite_fit(spark):
    x = np.array([[float(i), 0.0] for i in range(40)])
    fit = fit_logistic(table(spark, x, (x[:, 0] > 19.5).astype(float), np.ones(40)), features=["a"], label="y", weight="w", c=100.0)
    assert math.isfinite(fit.intercept) and fit.coefficients[0] > 1


def test_what_cannot_be_fitted_is_said(spark):
    x, y, w = sample(20)
    df = table(spark, x, y, w)
    with pytest.raises(ValueError, match="both classes"):
        fit_logistic(df.filter("y = 1"), features=["a"], label="y", weight="w")
    with pytest.raises(ValueError, match="both classes"):
        fit_logistic(df.filter("false"), features=["a"], label="y", weight="w")
    with pytest.raises(ValueError, match="without a label"):
        fit_logistic(df.selectExpr("if(a > 10, null, a) a", "y", "w"), features=["a"], label="y", weight="w")
    with pytest.raises(ValueError, match="needs features"):
        fit_logistic(df, features=[], label="y", weight="w")
