"""The normal distribution as a column expression."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

_TERMS = 80
_REACH = 5.6


def normal_cdf(z: Column) -> Column:
    """Phi(z), exact to double rounding within |z| <= 5.6 and constant beyond (tail below 1.1e-8).

    erf(x) = 2/sqrt(pi) * exp(-x*x) * x * (1 + 2xx/3 * (1 + 2xx/5 * (1 + ...))): all terms are
    positive, so nothing cancels.
    """
    bounded = F.least(F.lit(_REACH), F.greatest(F.lit(-_REACH), z))
    x = bounded / sqrt(2.0)
    q = 2 * x * x
    series = F.aggregate(
        F.sequence(F.lit(_TERMS), F.lit(1), F.lit(-1)), F.lit(1.0), lambda acc, n: 1.0 + q / (2 * n + 1) * acc
    )
    erf = (2.0 / sqrt(pi)) * F.exp(-x * x) * x * series
    return 0.5 * (1.0 + erf)


def normal_cdf_sql(z: str) -> str:
    """The same function as SQL text with list functions."""
    b = f"least({_REACH}, greatest(-{_REACH}, {z}))"
    x = f"({b} / sqrt(2.0))"
    series = f"list_reduce(range({_TERMS}, 0, -1), lambda acc, n: CAST(1 AS DOUBLE) + 2 * {x} * {x} / (2 * n + 1) * acc, CAST(1 AS DOUBLE))"
    return f"(0.5 * (1 + 2 / sqrt(pi()) * exp(-{x} * {x}) * {x} * {series}))"
