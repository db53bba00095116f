"""Exact integer arithmetic on nanosecond longs (`/` would go through a double)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x).cast("bigint")


def floor_div(value, by) -> Column:
    """Largest integer not above value / by."""
    v, b = _col(value), _col(by)
    return F.call_function("div", v - F.pmod(v, b), b)


def ceil_div(value, by) -> Column:
    return -floor_div(-_col(value), by)


def floor_to(value, by) -> Column:
    v, b = _col(value), _col(by)
    return v - F.pmod(v, b)
