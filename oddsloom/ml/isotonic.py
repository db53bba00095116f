"""Isotonic regression by pooling adjacent violators, in parallel over ranges of the predictor.

Equal predictors are one point. Points are cut into ranges at quantiles, and each range pools its violators into blocks of one
value. Ranges whose neighbouring blocks still violate the order are joined and pooled again, until no boundary does; as the
pooled blocks do not depend on the order of pooling, the result is that of one pass. Only the ranges' cuts and outer values meet the
driver. Blocks are found again by an as-of lookup, so neither the blocks nor the rows are ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.operators.asof import asof_backward
from oddsloom.operators.timeline import Timeline, following, scan
from oddsloom.session import release, settle

#: Points of a range.
RANGE_ROWS = 200_000


def pooled(lo: np.ndarray, hi: np.ndarray, total: np.ndarray, weight: np.ndarray) -> list[tuple]:
    """Blocks (lo, hi, total, weight) of ordered blocks, of which no one's mean is at or above the next one's."""
    out: list[list] = []
    for block in zip(lo.tolist(), hi.tolist(), total.tolist(), weight.tolist()):
        out.append(list(block))
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, end, s, w = out.pop()
            out[-1][1] = end
            out[-1][2] += s
            out[-1][3] += w
    return [tuple(b) for b in out]


def _range_of(lo: Column, cuts: list[float]) -> Column:
    """How many of the ordered cuts lie at or below a value."""
    if not cuts:
        return F.lit(0)
    known, steps = F.lit(cuts), F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    below = lambda at, step: (at + step <= len(cuts)) & (F.element_at(known, F.least(at + step, F.lit(len(cuts)))) <= lo)
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(below(at, step), step).otherwise(0))


def isotonic_blocks(df: DataFrame, *, p: str, y: str, weight: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(lo, hi, value, weight): the blocks of the non-decreasing step function with the least weighted squared error.

    Rows without predictor or label, or without a positive weight, are left out. Blocks of equal value are one."""
    usable = df.filter(F.col(p).isNotNull() & ~F.isnan(p) & F.col(y).isNotNull() & (F.col(weight) > 0))
    points = usable.groupBy(F.col(p).cast("double").alias("lo")).agg(
        F.sum(F.col(weight) * F.col(y)).cast("double").alias("total"), F.sum(weight).cast("double").alias("weight")
    )
    blocks = settle(points.select("lo", F.col("lo").alias("hi"), "total", "weight"))
    count = blocks.count()
    pieces = -(-count // range_rows)
    cuts = sorted(set(blocks.approxQuantile("lo", [k / pieces for k in range(1, pieces)], 1 / (4 * pieces)))) if pieces > 1 else []
    while True:
        ranged = blocks.withColumn("range", _range_of(F.col("lo"), cuts))

        def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Blocks arrive ordered by range and predictor; the open range's blocks are a stack."""
            names, held = ["lo", "hi", "total", "weight"], None
            for pdf in batches:
                for number, part in pdf.groupby("range", sort=True):
                    if held is not None and held["range"].iloc[0] != number:
                        yield held
                        held = None
                    rows = part if held is None else pd.concat([held, part])
                    held = pd.DataFrame(pooled(*(rows[c].to_numpy() for c in names)), columns=names).assign(range=number)
            if held is not None:
                yield held

        shape = "lo double, hi double, total double, weight double, range int"
        done = settle(ranged.repartition(len(cuts) + 1, "range").sortWithinPartitions("range", "lo").mapInPandas(pool, shape))
        release(blocks)
        value = F.col("total") / F.col("weight")
        ends = done.groupBy("range").agg(F.min("lo").alias("lo"), F.min_by(value, "lo").alias("first"), F.max_by(value, "lo").alias("last")).orderBy("range").collect()
        good = [b["lo"] for a, b in zip(ends, ends[1:]) if a["last"] < b["first"]]
        blocks = done.drop("range")
        if len(good) == max(0, len(ends) - 1):
            return blocks.select("lo", "hi", value.alias("value"), "weight")
        # Only boundaries that hold stay; the ranges on both sides of the others become one.
        cuts = good


def isotonic_value(rows: DataFrame, blocks: DataFrame, *, p: str, out: str, width: float = 1 / 256) -> DataFrame:
    """`rows` with the fitted value: that of a block inside it, a line between two blocks, the outer values beyond.

    Each predictor is looked up once, so that many rows of one predictor are not on one task's timeline."""
    one = F.lit(0).alias("__one")
    near = scan(
        blocks.select(one, "lo", "hi", "value"), Timeline.of("__one", "lo", width),
        {"__next": following(F.struct(F.col("lo").alias("lo"), F.col("value").alias("value")))},
    ).select("__one", F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), F.col("value").alias("__value"), "__next")
    least = blocks.agg(F.min_by("value", "lo").alias("__least"))
    probes = rows.select(F.col(p).cast("double").alias("__p")).filter("__p IS NOT NULL").distinct().select("*", one)
    met = asof_backward(probes, near, ["__one"], "__p", "__lo", ["__hi", "__value", "__next"], width)
    step = (F.col("__p") - F.col("__hi")) / (F.col("__next.lo") - F.col("__hi"))
    value = F.when(F.col("__lo").isNull(), F.col("__least")).when(
        (F.col("__p") <= F.col("__hi")) | F.col("__next").isNull(), F.col("__value")
    ).otherwise(F.col("__value") + step * (F.col("__next.value") - F.col("__value")))
    beside_least = met.join(F.broadcast(least.withColumn("__one", F.lit(0))), "__one")
    fitted = beside_least.select("__p", value.alias("__fitted"))
    columns = [c for c in rows.columns if c != out]
    return rows.withColumn("__p", F.col(p).cast("double")).join(fitted, "__p", "left").select(*columns, F.col("__fitted").alias(out))
