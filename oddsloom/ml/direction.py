"""Direction models: weighted logistic and boosted trees, calibrators, walk-forward predictions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.ml.isotonic import isotonic_blocks, isotonic_value
from oddsloom.ml.logistic import Logistic, fit_logistic
from oddsloom.operators.evaluate import calibration_line, clipped, log_loss, logit
from oddsloom.session import beside, settle

# Fixed values.
MIN_ISOTONIC_ROWS = 2_000
TEMPERATURES = (0.5, 0.75, 1.0, 1.5, 2.0)



def fit_trees(
    df: DataFrame, *, features: Sequence[str], label: str, weight: str, tail: str | None = None, depth: int = 4,
    iterations: int = 30, step: float = 0.1, seed: int = 17,
):
    """Boosted trees; with `tail` (a boolean column) the marked rows stop the boosting early."""
    trees = GBTClassifier(
        featuresCol="features", labelCol=label, weightCol=weight, maxDepth=depth, maxIter=iterations, stepSize=step, seed=seed
    )
    if tail:
        trees = trees.setValidationIndicatorCol(tail)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), trees]).fit(df)


def score(model, df: DataFrame, *, out: str = "p_raw") -> DataFrame:
    if isinstance(model, Logistic):
        return df.withColumn(out, model.probability())
    made = model.transform(df)
    return made.select(*df.columns, vector_to_array("probability")[1].alias(out))


# ---------------------------------------------------------------- calibration

def pick_temperature(df: DataFrame, *, p: str, y: str, weight: str, grid: Sequence[float] = TEMPERATURES) -> DataFrame:
    """Temperature with the lowest (log loss, Brier) among those beating no scaling on both; else NULL.

    All temperatures are scored in one aggregation over the rows.
    """
    x, w, Y = logit(F.col(p)), F.col(weight), F.col(y)
    temps = F.array(*[F.lit(float(t)) for t in sorted(set(grid))])
    laddered = df.select(x.alias("__x"), w.alias("__w"), Y.alias("__y"), clipped(F.col(p)).alias("__p")).withColumn(
        "temperature", F.explode(F.concat(F.array(F.lit(None).cast("double")), temps))
    )
    q = F.when(F.col("temperature").isNull(), F.col("__p")).otherwise(
        1 / (1 + F.exp(-F.col("__x") / F.col("temperature")))
    )
    scored = laddered.withColumn("__q", q).groupBy("temperature").agg(
        (F.sum(F.col("__w") * log_loss(F.col("__q"), F.col("__y"))) / F.sum("__w")).alias("log_loss"),
        (F.sum(F.col("__w") * (F.col("__q") - F.col("__y")) * (F.col("__q") - F.col("__y"))) / F.sum("__w")).alias("brier"),
    )
    base = scored.filter("temperature IS NULL").select(F.col("log_loss").alias("l0"), F.col("brier").alias("b0"))
    better = (F.col("log_loss") < F.col("l0")) & (F.col("brier") < F.col("b0"))
    return (
        beside(scored.filter("temperature IS NOT NULL"), base).agg(F.min_by("temperature", F.when(better, F.struct("log_loss", "brier", "temperature"))).alias("temperature"))
    )


def calibrator(df: DataFrame, *, p: str, y: str, weight: str, method: str) -> Callable[[DataFrame, str], DataFrame]:
    """Fitted on `df`: a function adding the calibrated probability under a new name."""

    def by_column(make: Callable[[Column], Column]) -> Callable[[DataFrame, str], DataFrame]:
        return lambda rows, out: rows.withColumn(out, make(F.col(p)))

    if method == "identity":
        return by_column(lambda c: c)
    if method == "sigmoid":
        a, b = calibration_line(df, p=p, y=y, weight=weight, ridge=1.0).first()
        if a is None:
            raise ValueError("calibration labels must contain both classes")
        return by_column(lambda c: 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * logit(c)))))
    if method == "temperature":
        t = pick_temperature(df, p=p, y=y, weight=weight).first()[0]
        return by_column((lambda c: c) if t is None else (lambda c: 1 / (1 + F.exp(-logit(c) / F.lit(t)))))
    if method == "isotonic":
        if df.count() < MIN_ISOTONIC_ROWS:
            raise ValueError(f"isotonic calibration needs at least {MIN_ISOTONIC_ROWS} rows")
        blocks = isotonic_blocks(df, p=p, y=y, weight=weight)
        return lambda rows, out: isotonic_value(rows, blocks, p=p, out=out)
    raise ValueError(f"unknown calibration {method}")


# ---------------------------------------------------------------- walk forward

def out_of_fold(
    samples: DataFrame, folds: DataFrame, *, features: Sequence[str], label: str, weight: str, sample: str = "sample_id",
    calibration: str = "temperature", c: float = 1.0, keep: Sequence[str] = (),
) -> DataFrame:
    """Predictions on every fold's test rows by a model fitted on its training rows and calibrated on
    its calibration rows. The loop is over the few folds; each fit is a distributed job."""
    columns = dict.fromkeys([sample, *features, label, weight, *keep])
    used = folds.filter("fold >= 0").select("fold", "role", sample)
    # A fit reads its part once a step, so each lies in a folder of its own.
    rows = settle(samples.select(*columns).join(used, sample), by=["fold", "role"])
    numbers = [r.fold for r in rows.select("fold").distinct().orderBy("fold").collect()]
    parts = []
    for k in numbers:
        part = rows.filter(F.col("fold") == k)
        parts.append(
            _fit_and_score(
                part.filter("role = 'train'"), part.filter("role = 'calibration'"), part.filter("role = 'test'"),
                features=features, label=label, weight=weight, calibration=calibration, c=c,
            ).select(F.lit(k).cast("bigint").alias("fold"), sample, "p_up", label, weight, *keep)
        )
    if not parts:
        raise ValueError("no complete fold")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sealed_holdout(
    samples: DataFrame, folds: DataFrame, *, features: Sequence[str], label: str, weight: str, feature_ts: str,
    label_ts: str, group: str, train_ns: int, calibration_ns: int, embargo_ns: int, sample: str = "sample_id",
    calibration: str = "temperature", c: float = 1.0, keep: Sequence[str] = (),
) -> DataFrame:
    """Refit right before the sealed part, with the same embargo, and predict it once."""
    # A group is sealed as a whole, and lies in at most one of the three parts, as an embargo parts them.
    sealed = folds.filter("role = 'holdout'").select(group).distinct().withColumn("__sealed", F.lit(True))
    spans = samples.groupBy(group).agg(
        F.min(feature_ts).alias("__lo"), F.max(feature_ts).alias("__hi"), F.max(label_ts).alias("__known")
    )
    spans = settle(spans.join(sealed, group, "left"))
    start = spans.filter("__sealed").agg(F.min("__lo")).first()[0]
    cal_end = start - embargo_ns
    cal_start = cal_end - calibration_ns
    train_end = cal_start - embargo_ns

    def inside(begin: int, end: int) -> Column:
        return (F.col("__lo") >= begin) & (F.col("__hi") < end) & (F.col("__known") <= end)

    role = F.when(F.col("__sealed"), "test").when(inside(train_end - train_ns, train_end), "train").when(
        inside(cal_start, cal_end), "calibration"
    )
    put = spans.select(group, role.alias("__role")).filter("__role IS NOT NULL")
    columns = dict.fromkeys([sample, *features, label, weight, *keep])
    # Every step of a fit reads its part again: from the table, not through the join.
    rows = settle(samples.join(put, group).select(*columns, "__role"), by=["__role"])
    part = lambda name: rows.filter(F.col("__role") == name)
    out = _fit_and_score(
        part("train"), part("calibration"), part("test"),
        features=features, label=label, weight=weight, calibration=calibration, c=c,
    )
    return out.select(sample, "p_up", label, weight, *keep)


def _fit_and_score(train, calibrate, test, *, features, label, weight, calibration, c):
    model = fit_logistic(train, features=features, label=label, weight=weight, c=c)
    fix = calibrator(score(model, calibrate), p="p_raw", y=label, weight=weight, method=calibration)
    return fix(score(model, test), "p_fixed").withColumn("p_up", clipped(F.col("p_fixed")))


def mispricing(predictions: DataFrame, market: DataFrame, *, on: Sequence[str]) -> DataFrame:
    """Model probability next to boundary and market probability, and the difference to the market."""
    return predictions.join(market, list(on)).withColumn("mispricing", F.col("p_up") - F.col("p_market_mid_up"))
