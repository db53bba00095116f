"""Quality rows over raw tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.operators.timeline import Timeline, previous, scan


def kline_quality(
    klines: DataFrame, *, keys: Sequence[str], order: Sequence[str], open_ts: str, close: str, volume: str, width: int
) -> DataFrame:
    """Bars with a non-positive or non-finite close, a negative volume, or a non-increasing open time."""
    out = scan(klines, Timeline.of(keys, order, width), {"__was": previous(F.col(open_ts))})
    c, v = F.col(close).cast("double"), F.col(volume).cast("double")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return out.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(odd(c) | (c <= 0)).alias("bad_close"),
        F.count_if(odd(v) | (v < 0)).alias("bad_volume"),
        F.count_if(F.col(open_ts) <= F.col("__was")).alias("not_increasing"),
    )
