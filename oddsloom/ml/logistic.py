"""Weighted logistic regression by Newton steps on sums.

Features are standardised by weighted mean and population deviation; a constant feature keeps its scale. The penalty
||b||^2 / 2 spares the intercept and stands beside C times the summed loss. Every step is one aggregation over the rows: the
driver gets a gradient and a Hessian, whose size is that of the features, never rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Logistic:
    """A fit: `intercept` and `coefficients` belong to the standardised features."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    intercept: float
    coefficients: tuple[float, ...]

    def standardised(self) -> list[Column]:
        return [(F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(self.features, self.means, self.scales, strict=True)]

    def probability(self) -> Column:
        z = F.lit(self.intercept)
        for x, b in zip(self.standardised(), self.coefficients, strict=True):
            z = z + F.lit(b) * x
        return 1 / (1 + F.exp(-z))


def _floats(row) -> list[float]:
    return [float(x) for x in row]


def moments(df: DataFrame, *, features: Sequence[str], label: str, weight: str) -> tuple[list[float], list[float]]:
    """Weighted means and population deviations, 1 for a constant feature. Rows must be complete and of both classes."""
    w, k = F.col(weight), len(features)
    holes = F.greatest(F.lit(False), *[F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in (*features, label, weight)])
    first = df.agg(
        F.sum(w).alias("w"), F.sum(w * F.col(label)).alias("wy"), F.count_if(holes).alias("holes"), *[F.sum(w * F.col(c)).alias(f"s{i}") for i, c in enumerate(features)]
    ).first()
    if first.holes:
        raise ValueError("rows without a label, a weight or a feature")
    if not first.w or not 0 < first.wy < first.w:
        raise ValueError("labels must contain both classes")
    means = [float(first[f"s{i}"]) / float(first.w) for i in range(k)]
    squares = df.agg(*[F.sum(w * (F.col(c) - F.lit(m)) * (F.col(c) - F.lit(m))).alias(f"v{i}") for i, (c, m) in enumerate(zip(features, means))]).first()
    # What is left of a constant feature's squares is rounding.
    scales = [math.sqrt(float(v) / float(first.w)) for v in squares]
    return means, [s if s > 1e-12 * max(1.0, abs(m)) else 1.0 for s, m in zip(scales, means)]


def fit_logistic(
    df: DataFrame, *, features: Sequence[str], label: str, weight: str, c: float = 1.0, iterations: int = 100
) -> Logistic:
    """The fit for labels 0 and 1. Steps that lower the penalised likelihood are halved; ValueError if none is found in `iterations`."""
    if not features:
        raise ValueError("a fit needs features")
    means, scales = moments(df, features=features, label=label, weight=weight)
    k = len(features) + 1
    made = Logistic(tuple(features), tuple(means), tuple(scales), 0.0, (0.0,) * (k - 1))
    rows = df.select(F.col(weight).cast("double").alias("w"), F.col(label).cast("double").alias("y"), F.lit(1.0).alias("z0"), *[z.alias(f"z{i + 1}") for i, z in enumerate(made.standardised())])
    ridge = np.array([0.0] + [1.0 / c] * (k - 1))
    beta, step, before = np.zeros(k), np.zeros(k), -math.inf
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    for _ in range(iterations):
        z = F.lit(float(beta[0]))
        for i in range(1, k):
            z = z + F.lit(float(beta[i])) * F.col(f"z{i}")
        at = rows.withColumn("z", z).withColumn("mu", 1 / (1 + F.exp(-F.col("z"))))
        at = at.withColumns({"r": F.col("w") * (F.col("y") - F.col("mu")), "v": F.col("w") * F.col("mu") * (1 - F.col("mu"))})
        softplus = F.greatest("z", F.lit(0.0)) + F.log1p(F.exp(-F.abs("z")))
        sums = _floats(at.agg(
            F.sum(F.col("w") * (F.col("y") * F.col("z") - softplus)), *[F.sum(F.col("r") * F.col(f"z{i}")) for i in range(k)],
            *[F.sum(F.col("v") * F.col(f"z{i}") * F.col(f"z{j}")) for i, j in upper],
        ).first())
        reached = sums[0] - float(ridge @ (beta * beta)) / 2
        if reached < before - 1e-9 * abs(before):
            step = step / 2
            beta = beta - step
            continue
        before = reached
        hessian = np.diag(ridge)
        for (i, j), h in zip(upper, sums[1 + k :], strict=True):
            hessian[i, j] += h
            if i != j:
                hessian[j, i] += h
        step = np.linalg.solve(hessian, np.array(sums[1 : 1 + k]) - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-10 * (1 + np.abs(beta).max()):
            return Logistic(made.features, made.means, made.scales, float(beta[0]), tuple(float(b) for b in beta[1:]))
    raise ValueError(f"no fit in {iterations} steps")
