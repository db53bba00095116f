"""Division and logarithm that answer zeros as SQL engines with IEEE doubles do, where Spark raises or gives null; and their rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def ratio(a: Column, b: Column) -> Column:
    """a / b; over zero infinity with the sign of a, and NaN for 0 / 0. Null stays null."""
    a, b = a.cast("double"), b.cast("double")
    over = F.when(a.isNull(), F.lit(None).cast("double")).when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, over).otherwise(a / F.nullif(b, F.lit(0.0)))


def log(x: Column) -> Column:
    """ln x; minus infinity at zero, NaN below."""
    return F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(F.log(x))


def round_scaled(x: Column, places: int) -> Column:
    """Halves away from zero of the scaled double; Spark's round goes by the decimal digits, which may fall on the other side."""
    scale = float(10**places)
    return F.when(F.isnan(x) | (F.abs(x) == INF), x).otherwise(F.round(x * scale) / scale)
