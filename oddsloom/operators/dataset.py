"""Decision grids, whole-market datasets and leakage-safe splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsloom.functions.integers import floor_div
from oddsloom.operators.timeline import Timeline, scan
from oddsloom.session import DAY_NS, HOUR_NS, NANOS, beside

MINUTE_NS = 60 * NANOS

# The default walk-forward protocol.
PROTOCOL = {
    "train": 90 * DAY_NS,
    "calibration": 21 * DAY_NS,
    "test": 14 * DAY_NS,
    "step": 14 * DAY_NS,
    "embargo": 4 * HOUR_NS + 15 * MINUTE_NS,
    "holdout": 28 * DAY_NS,
}



def decision_grid(markets: DataFrame, *, t0: str, offsets_ns: Sequence[int]) -> DataFrame:
    """One row per market and offset; the offsets are a literal list, exploded in place."""
    return markets.withColumn("offset_ns", F.explode(F.array(*[F.lit(int(o)) for o in offsets_ns]))).withColumn(
        "decision_ts", F.col(t0) + F.col("offset_ns")
    )


def whole_market_dataset(
    snapshots: DataFrame, *, market: str, resolution: str, failure: Column, expected: int
) -> DataFrame:
    """Per market: the reason it is left out, if any, and its snapshots' weight.

    A market counts only with a binary resolution, all expected snapshots and no failing one. The
    first failing snapshot's reason (by `decision_ts`) names the market's.
    """
    return snapshots.groupBy(market).agg(
        F.max(resolution).alias("resolution"),
        F.count(F.lit(1)).alias("snapshots"),
        F.min_by(failure, F.when(failure.isNotNull(), F.col("decision_ts"))).alias("failure"),
    ).select(
        market,
        F.when(F.col("resolution").isNull(), "unresolved")
        .when(~F.col("resolution").isin("up", "down"), "void")
        .when(F.col("snapshots") < expected, "incomplete")
        .otherwise(F.col("failure"))
        .alias("excluded"),
        (F.lit(1.0) / F.col("snapshots")).alias("weight"),
    )


def dataset_rows(snapshots: DataFrame, verdicts: DataFrame, *, market: str, resolution: str) -> DataFrame:
    """Snapshots of the included markets with label, weight, sample id and group."""
    return (
        snapshots.join(verdicts.filter("excluded IS NULL").select(market, "weight"), market)
        .withColumn("label", (F.col(resolution) == "up").cast("int"))
        .withColumn("sample_id", F.concat_ws("@", F.col(market), F.col("decision_ts").cast("string")))
        .withColumn("group_id", F.col(market))
    )


def walk_forward(
    samples: DataFrame,
    *,
    sample: str = "sample_id",
    group: str = "group_id",
    feature_ts: str = "feature_ts",
    label_ts: str = "label_available_ts",
    train: int = PROTOCOL["train"],
    calibration: int = PROTOCOL["calibration"],
    test: int = PROTOCOL["test"],
    step: int = PROTOCOL["step"],
    embargo: int = PROTOCOL["embargo"],
    holdout: int = PROTOCOL["holdout"],
    width: int = DAY_NS,
) -> DataFrame:
    """(fold, role, sample) rows of rolling train / calibration / test windows, and the sealed holdout.

    A group enters a window only if all its samples lie inside it and, for training and calibration,
    all its labels were known by the window's end. Groups touching the last `holdout` span are
    sealed (fold -1) and never part of a fold. Folds lacking one of the three roles are dropped.
    A group's candidate folds follow arithmetically from its time span, so groups are not compared
    with every fold.
    """
    # Group spans travel with their samples; two-level, so that one huge group stays splittable.
    rows = samples.select(sample, group, feature_ts, label_ts)
    spans = rows.groupBy(group).agg(
        F.min(feature_ts).alias("lo"), F.max(feature_ts).alias("hi"), F.max(label_ts).alias("deadline")
    )
    ends = spans.agg(F.min("lo").alias("first"), F.max("hi").alias("last"))
    spans = beside(spans, ends).withColumn("sealed", F.col("hi") >= F.col("last") - holdout)
    spans = beside(spans, spans.filter("sealed").agg(F.min("lo").alias("sealed_start")))
    first_test = F.col("first") + (train + calibration + 2 * embargo)
    # Fold k tests [first_test + k*step, + test), as long as that ends before the sealed part.
    folds_until = floor_div(F.col("sealed_start") - test - first_test, step)
    role_windows = {
        "train": (-(calibration + 2 * embargo + train), -(calibration + 2 * embargo)),
        "calibration": (-(calibration + embargo), -embargo),
        "test": (0, test),
    }
    parts = []
    for role, (begin, end) in role_windows.items():
        # start_k <= lo and hi < end_k
        hi_k = F.least(floor_div(F.col("lo") - first_test - begin, step), folds_until)
        lo_k = floor_div(F.col("hi") - first_test - end, step) + 1
        known = F.lit(True) if role == "test" else F.col("deadline") <= first_test + F.col("fold") * step + end
        parts.append(
            spans.filter("NOT sealed")
            .withColumns({"__lo": F.greatest(lo_k, F.lit(0).cast("bigint")), "__hi": hi_k})
            .filter("__lo <= __hi")
            .withColumn("fold", F.explode(F.sequence("__lo", "__hi")))
            .filter(known)
            .select(group, "fold", F.lit(role).alias("role"))
        )
    member = parts[0].unionByName(parts[1]).unionByName(parts[2])
    complete = member.groupBy("fold").agg(F.countDistinct("role").alias("n")).filter("n = 3")
    # One row per fold: numbering them in one task is bounded by the length of the study.
    complete = complete.select(
        "fold", (F.row_number().over(Window.orderBy("fold")) - 1).cast("bigint").alias("__index")
    )
    sealed = spans.filter("sealed").select(group, F.lit(-1).cast("bigint").alias("fold"), F.lit("holdout").alias("role"))
    member = member.join(complete, "fold").select(group, F.col("__index").alias("fold"), "role").unionByName(sealed)
    return rows.select(sample, group).join(member, group).select("fold", "role", sample, group)


def early_stopping_split(
    samples: DataFrame, *, group: str, order: Sequence[str], fraction: float, width: int
) -> DataFrame:
    """`tail` marks the samples of all groups that reach into the last `fraction` of the rows."""
    from oddsloom.operators.timeline import before, running_count, whole_sum

    line = Timeline.of("__all", list(order), width)
    placed = scan(
        samples.withColumn("__all", F.lit(0)),
        line,
        {"__pos": before(running_count()), "__n": whole_sum(F.lit(1).cast("bigint"))},
    )
    count = F.greatest(F.lit(2), F.bround(F.col("__n") * fraction, 0).cast("bigint"))
    placed = placed.withColumn("__late", F.col("__pos") >= F.col("__n") - count)
    late = placed.groupBy(group).agg(F.max("__late").alias("tail"))
    return placed.join(late, group).drop("__pos", "__n", "__late", "__all")


def coverage_audit(grid: DataFrame, observed: DataFrame, *, keys: Sequence[str], market: str, flagged: Column) -> DataFrame:
    """Requested, observed, missing and flagged decisions per market."""
    seen = observed.select(*keys, flagged.alias("__flag")).groupBy(*keys).agg(F.max("__flag").alias("__flag"))
    return grid.join(seen.withColumn("__hit", F.lit(1)), list(keys), "left").groupBy(market).agg(
        F.count(F.lit(1)).alias("requested"),
        F.count("__hit").alias("observed"),
        F.count(F.when(F.col("__hit").isNull(), 1)).alias("missing"),
        F.count(F.when(F.col("__flag"), 1)).alias("flagged"),
    )


__all__ = [
    "PROTOCOL", "coverage_audit", "dataset_rows", "decision_grid", "early_stopping_split",
    "walk_forward", "whole_market_dataset",
]
