"""Scores, calibration, bootstrap intervals, gates and model selection over forecasts and fills."""

from __future__ import annotations

import math

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsloom.functions.integers import floor_div
from oddsloom.operators.edge import entry_metrics, first_persistent_entry, utc_day
from oddsloom.operators.timeline import quantiles
from oddsloom.session import DAY_NS, beside, release, settle

# Fixed values.
EPSILON = 1e-6
TEN_BINS = tuple(i / 10 for i in range(11))
CONFIDENCE_BANDS = ((0.55, 0.60), (0.60, 0.65), (0.65, 0.70), (0.70, 1.00))
THRESHOLDS = (0.0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.075, 0.10)

DIRECTION_LIMITS = {
    "holdout_markets": 2_500,
    "log_loss_improvement": 0.002,
    "brier_improvement": 0.001,
    "slope_min": 0.8,
    "slope_max": 1.2,
    "bin_samples": 300,
    "bin_error": 0.03,
}
MAKER_LIMITS = {
    "total_fills": 500,
    "side_fills": 150,
    "net_ev_per_share": 0.005,
    "positive_week_ratio": 0.70,
    "month_pnl_share": 0.50,
}


def clipped(p: Column, eps: float = EPSILON) -> Column:
    return F.least(F.lit(1.0 - eps), F.greatest(F.lit(eps), p))


def logit(p: Column) -> Column:
    q = clipped(p)
    return F.log(q / (1 - q))


def log_loss(p: Column, y: Column) -> Column:
    q = clipped(p)
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def bin_index(p: Column, edges: Sequence[float] = TEN_BINS) -> Column:
    """Half-open bins on the given edges; the last one is closed."""
    out = F.when(p < edges[0], None)
    for i, upper in enumerate(edges[1:-1]):
        out = out.when(p < upper, i)
    return out.when(p <= edges[-1], len(edges) - 2)


def arange_bin_index(p: Column) -> Column:
    """Ten bins whose edges carry the rounding of repeated steps of 0.1, as the weighted error uses."""
    out = None
    for i in range(10):
        lower = i * 0.1
        upper = lower + 0.1
        inside = (p >= lower) & ((p < upper) if upper < 1.0 else (p <= upper))
        out = F.when(inside, i) if out is None else out.when(inside, i)
    return out


def probability_scores(
    df: DataFrame, *, p: str, y: str, groups: Sequence[Sequence[str]] = ((),), edges: Sequence[float] = TEN_BINS
) -> DataFrame:
    """Count, Brier, clipped log loss and calibration error for each grouping set in one pass.

    Rows are first summed per (group, bin), so what is shuffled is a few rows per task.
    """
    names = list(dict.fromkeys(c for g in groups for c in g))
    P, Y = F.col(p), F.col(y)
    base = df.withColumn("__bin", bin_index(P, edges)).groupBy(*names, "__bin").agg(
        F.count(F.lit(1)).alias("__n"),
        F.sum(P).alias("__p"),
        F.sum(Y).alias("__y"),
        F.sum((P - Y) * (P - Y)).alias("__brier"),
        F.sum(log_loss(P, Y)).alias("__ll"),
    )
    sets = [[F.col(c) for c in (*g, "__bin")] for g in groups]
    per_bin = base.groupingSets(sets, *[F.col(c) for c in (*names, "__bin")]).agg(
        *[F.sum(c).alias(c) for c in ("__n", "__p", "__y", "__brier", "__ll")],
        *([F.grouping_id().alias("__set")]),
    )
    gap = F.abs(F.col("__p") - F.col("__y"))
    return per_bin.groupBy(*names, "__set").agg(
        F.sum("__n").alias("count"),
        (F.sum("__brier") / F.sum("__n")).alias("brier_score"),
        (F.sum("__ll") / F.sum("__n")).alias("log_loss"),
        (F.sum(gap) / F.sum("__n")).alias("calibration_error"),
    ).drop("__set")


def calibration_bins(df: DataFrame, *, p: str, y: str, edges: Sequence[float] = TEN_BINS) -> DataFrame:
    """One row per bin, empty ones included."""
    spark = df.sparkSession
    dim = spark.createDataFrame(
        [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, lower double, upper double"
    )
    sums = df.groupBy(bin_index(F.col(p), edges).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.avg(p).alias("mean_probability"), F.avg(y).alias("observed_rate")
    )
    return dim.join(sums, "bin", "left").select(
        "bin", "lower", "upper", F.coalesce("count", F.lit(0).cast("bigint")).alias("count"),
        "mean_probability", "observed_rate",
        F.abs(F.col("mean_probability") - F.col("observed_rate")).alias("absolute_error"),
    )


def calibration_line(
    df: DataFrame, *, p: str, y: str, weight: str | None = None, ridge: float = 0.0, iterations: int = 100
) -> DataFrame:
    """Intercept and slope of a logistic fit on the forecast's logit; NULL with one class only.

    Newton steps on two parameters, halved while they lower the likelihood: each iteration brings six sums to the
    driver. Rows are first summed per distinct forecast. `ridge` penalises the slope (1/C of the usual parameterisation).
    NULL too where no finite line is best, as on forecasts that part the classes, or none is found in `iterations`.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    data = settle(
        df.groupBy(logit(F.col(p)).alias("x")).agg(F.sum(w).alias("w"), F.sum(w * F.col(y)).alias("wy"))
    )
    spark = df.sparkSession
    schema = "intercept double, slope double"
    totals = data.agg(F.sum("w").alias("w"), F.sum("wy").alias("wy")).first()
    if not totals.w or totals.wy <= 0 or totals.wy >= totals.w:
        return spark.createDataFrame([(None, None)], schema)
    a = b = da = db = 0.0
    before, found = -math.inf, None
    for _ in range(iterations):
        z = F.lit(a) + F.lit(b) * F.col("x")
        mu = 1 / (1 + F.exp(-z))
        v = F.col("w") * mu * (1 - mu)
        r = F.col("wy") - F.col("w") * mu
        # ln(mu) and ln(1 - mu) without overflow.
        softplus = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
        s = data.agg(
            F.sum(r).alias("g0"), F.sum(r * F.col("x")).alias("g1"), F.sum(v).alias("h00"), F.sum(v * F.col("x")).alias("h01"),
            F.sum(v * F.col("x") * F.col("x")).alias("h11"), F.sum(F.col("wy") * z - F.col("w") * softplus).alias("ll"),
        ).first()
        reached = s.ll - ridge * b * b / 2
        if reached < before - 1e-9 * abs(before):
            da, db = da / 2, db / 2
            a, b = a - da, b - db
            continue
        g1, h11 = s.g1 - ridge * b, s.h11 + ridge
        det = s.h00 * h11 - s.h01 * s.h01
        if det <= 0 or ridge == 0 and s.ll > -1e-6 * totals.w:
            break
        before = reached
        da, db = (h11 * s.g0 - s.h01 * g1) / det, (s.h00 * g1 - s.h01 * s.g0) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-12 * (1 + abs(a) + abs(b)):
            found = (float(a), float(b))
            break
    release(data)
    return spark.createDataFrame([found or (None, None)], schema)


def weighted_calibration_error(df: DataFrame, *, p: str, y: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    w = F.col(weight)
    bins = df.withColumn("__bin", arange_bin_index(F.col(p))).groupBy(*by, "__bin").agg(
        F.sum(w).alias("__w"), F.sum(w * F.col(p)).alias("__p"), F.sum(w * F.col(y)).alias("__y")
    )
    return bins.groupBy(*by).agg(
        (F.sum(F.when(F.col("__bin").isNotNull(), F.abs(F.col("__y") - F.col("__p")))) / F.sum("__w")).alias(
            "weighted_calibration_error"
        )
    )


def confidence_bands(df: DataFrame, *, p: str, y: str, weight: str, market: str) -> DataFrame:
    """Directional confidence bands with distinct markets; an empty band has error 1."""
    conf = F.greatest(F.col(p), 1 - F.col(p))
    band = None
    for i, (lo, hi) in enumerate(CONFIDENCE_BANDS):
        inside = (conf >= lo) & ((conf < hi) if hi < 1.0 else (conf <= hi))
        band = F.when(inside, i) if band is None else band.when(inside, i)
    right = ((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("double")
    w = F.col(weight)
    sums = (
        df.withColumn("band", band.cast("int"))
        .filter("band IS NOT NULL")
        .groupBy("band")
        .agg(
            F.count(F.lit(1)).alias("snapshot_count"),
            F.countDistinct(market).alias("effective_market_count"),
            (F.sum(w * conf) / F.sum(w)).alias("mean_confidence"),
            (F.sum(w * right) / F.sum(w)).alias("observed_accuracy"),
        )
    )
    dim = df.sparkSession.createDataFrame(
        [(i, lo, hi) for i, (lo, hi) in enumerate(CONFIDENCE_BANDS)], "band int, lower double, upper double"
    )
    zero = F.lit(0).cast("bigint")
    return dim.join(sums, "band", "left").select(
        "band", "lower", "upper", F.coalesce("snapshot_count", zero).alias("snapshot_count"),
        F.coalesce("effective_market_count", zero).alias("effective_market_count"),
        "mean_confidence", "observed_accuracy",
        F.coalesce(F.abs(F.col("observed_accuracy") - F.col("mean_confidence")), F.lit(1.0)).alias("calibration_error"),
    )


# ---------------------------------------------------------------- maker fills

def edge_attribution(*, p_boundary: str, p_fair: str, p_market: str, price: str) -> dict[str, Column]:
    """Where an outcome-side edge comes from."""
    b, f, m, x = (F.col(c) for c in (p_boundary, p_fair, p_market, price))
    return {
        "boundary_probability_edge": b - 0.5,
        "opening_information_edge": f - b,
        "maker_discount": F.lit(0.5) - x,
        "market_mispricing_edge": f - m,
    }


def maker_fill_summary(df: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Shares, expected value, realised profit, per-share values, fees and rebates of fills."""
    net = F.col("shares") * (F.col("p_fair") - F.col("entry_price")) - F.col("fee") + F.col("rebate")
    real = F.col("shares") * (F.col("outcome") - F.col("entry_price")) - F.col("fee") + F.col("rebate")
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"),
        F.sum("shares").alias("total_shares"),
        F.sum(net).alias("net_expected_value"),
        F.sum(real).alias("realized_pnl"),
        F.sum("fee").alias("total_fee"),
        F.sum("rebate").alias("total_rebate"),
    )
    return sums.withColumns(
        {
            "net_expected_value_per_share": F.col("net_expected_value") / F.col("total_shares"),
            "realized_pnl_per_share": F.col("realized_pnl") / F.col("total_shares"),
        }
    )


def pnl_concentration(df: DataFrame, *, pnl: str, ts: str, by: Sequence[str], width: float) -> DataFrame:
    """Share of positive weeks, the largest month's share of profit, and profit without the top 1 %."""
    week = floor_div(ts, 7 * DAY_NS)
    month = F.date_trunc("month", F.timestamp_micros(floor_div(ts, 1000)))
    weeks = df.groupBy(*by, week.alias("__t")).agg(F.sum(pnl).alias("__w"))
    months = df.groupBy(*by, month.alias("__t")).agg(F.sum(pnl).alias("__m"))
    w = weeks.groupBy(*by).agg(F.avg(F.when(F.col("__w") > 0, 1.0).otherwise(0.0)).alias("positive_week_ratio"))
    m = months.groupBy(*by).agg(F.max("__m").alias("__top"), F.sum("__m").alias("total_pnl"))
    cut = quantiles(df, list(by), pnl, {"__cut": 0.99}, width)
    kept = df.join(cut, list(by)).filter(F.col(pnl) <= F.col("__cut")).groupBy(*by).agg(
        F.sum(pnl).alias("pnl_without_top_one_percent")
    )
    share = F.when(F.col("total_pnl") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("__top") / F.col("total_pnl"))))
    return (
        m.join(w, list(by)).join(kept, list(by), "left")
        .withColumn("largest_month_pnl_share", F.coalesce(share, F.lit(1.0)))
        .drop("__top")
    )


# ---------------------------------------------------------------- bootstrap

# Slots drawn in one go, and tasks the draws of a bootstrap are dealt over (fixed values).
DRAWN_SLOTS = 10_000
DRAW_TASKS = 96

def _day_draws(daily: DataFrame, by: Sequence[str], iterations: int, seed: int) -> DataFrame:
    """Each iteration draws as many days as the key has, by a hash of (seed, iteration, slot).

    Days times iterations are drawn: iterations and stretches of slots are dealt over the tasks before they are spelled out, and
    meet a broadcast of the days' sums: a row per key and day, some 365 a year whatever the input.
    """
    spec = Window.partitionBy(*by).orderBy("__day")
    numbered = settle(daily.withColumn("__i", F.row_number().over(spec) - 1))
    sizes = numbered.groupBy(*by).agg(F.count(F.lit(1)).alias("__days"))
    stretch = F.lit(DRAWN_SLOTS).cast("bigint")
    starts = sizes.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1)))).withColumn(
        "__from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__days") - 1, stretch))
    )
    dealt = starts.repartition(DRAW_TASKS, *by, "__b", "__from")
    slots = dealt.withColumn("__slot", F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + stretch, F.col("__days")) - 1)))
    text = F.concat_ws(":", F.lit(str(seed)), F.col("__b").cast("string"), F.col("__slot").cast("string"))
    draw = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % F.col("__days")
    # By Spark's estimate the draws are as few as the keys, and would be the side that is broadcast.
    return slots.withColumn("__i", draw).join(F.broadcast(numbered), [*by, "__i"])


def bootstrap_mean_ci(
    df: DataFrame, *, value: str, ts: str, by: Sequence[str] = (), iterations: int = 1_000, seed: int = 17
) -> DataFrame:
    """95 % interval of the mean, resampling whole UTC days; a single day gives its mean twice."""
    keys = list(by) or ["__all"]
    rows = df if by else df.withColumn("__all", F.lit(0))
    daily = rows.groupBy(*keys, utc_day(ts).alias("__day")).agg(
        F.sum(value).alias("__sum"), F.count(value).alias("__n")
    )
    means = _day_draws(daily, keys, iterations, seed).groupBy(*keys, "__b").agg(
        (F.sum("__sum") / F.sum("__n")).alias("__mean")
    )
    # `iterations` values per key.
    out = means.groupBy(*keys).agg(
        F.percentile("__mean", 0.025).alias("ci95_lower"), F.percentile("__mean", 0.975).alias("ci95_upper")
    )
    return out if by else out.drop("__all")


def paired_predictions(
    candidate: DataFrame, baseline: DataFrame, *, sample: str, p: str, y: str, keep: Sequence[str] = ()
) -> DataFrame:
    """Candidate and baseline forecasts of the same samples; any missing key or other label fails."""
    b = baseline.select(sample, F.col(p).alias("p_baseline"), F.col(y).alias("__y"))
    both = candidate.withColumnRenamed(p, "p_candidate").join(b, sample, "full_outer")
    whole = F.col("p_candidate").isNotNull() & F.col("p_baseline").isNotNull() & (F.col(y) == F.col("__y"))
    checked = F.when(whole, F.col("p_candidate")).otherwise(
        F.raise_error(F.lit("paired predictions need the same samples and labels")).cast("double")
    )
    return both.select(sample, checked.alias("p_candidate"), "p_baseline", y, *keep)


def paired_bootstrap(
    pairs: DataFrame, *, y: str, weight: str, ts: str, iterations: int = 2_000, seed: int = 17
) -> DataFrame:
    """Weighted improvement of log loss and Brier over a baseline, with day-block intervals."""
    Y, w = F.col(y), F.col(weight)
    c, b = clipped(F.col("p_candidate")), clipped(F.col("p_baseline"))
    ll = log_loss(F.col("p_baseline"), Y) - log_loss(F.col("p_candidate"), Y)
    br = (Y - b) * (Y - b) - (Y - c) * (Y - c)
    daily = pairs.withColumn("__all", F.lit(0)).groupBy("__all", utc_day(ts).alias("__day")).agg(
        F.sum(w).alias("__w"), F.sum(w * ll).alias("__ll"), F.sum(w * br).alias("__br")
    )
    point = daily.agg(
        (F.sum("__ll") / F.sum("__w")).alias("log_loss_improvement"),
        (F.sum("__br") / F.sum("__w")).alias("brier_improvement"),
        F.count(F.lit(1)).alias("days"),
    )
    boot = _day_draws(daily, ["__all"], iterations, seed).groupBy("__b").agg(
        (F.sum("__ll") / F.sum("__w")).alias("__l"), (F.sum("__br") / F.sum("__w")).alias("__r")
    )
    ci = boot.agg(
        F.percentile("__l", 0.025).alias("log_loss_ci_lower"), F.percentile("__l", 0.975).alias("log_loss_ci_upper"),
        F.percentile("__r", 0.025).alias("brier_ci_lower"), F.percentile("__r", 0.975).alias("brier_ci_upper"),
    )
    return beside(point, ci).filter("days >= 2")


def threshold_sweep(
    candidates: DataFrame,
    *,
    market: str,
    ts: str,
    requested_markets: int,
    signals: int,
    max_gap: int,
    width: int | None,
    by: Sequence[str] = (),
    thresholds: Sequence[float] = THRESHOLDS,
    iterations: int = 1_000,
    seed: int = 17,
) -> DataFrame:
    """Entry metrics and intervals for every threshold (and group) in one plan."""
    laddered = candidates.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    entries = settle(
        first_persistent_entry(
            laddered, market=[*by, "threshold", market], ts=ts, side="side",
            passes=F.col("predicted_edge") >= F.col("threshold"), signals=signals, max_gap=max_gap, width=width,
        )
    )
    keys = [*by, "threshold"]
    metrics = entry_metrics(entries, keys)
    ci = bootstrap_mean_ci(entries, value="pnl_per_share", ts=ts, by=keys, iterations=iterations, seed=seed)
    return metrics.join(ci, keys).withColumn("market_coverage", F.col("entry_count") / requested_markets)


def pick_threshold(sweep: DataFrame, *, min_entries: int, by: Sequence[str] = ()) -> DataFrame:
    """Best threshold by (lower bound, value, lower threshold) among those with entries and a positive bound."""
    ok = sweep.filter((F.col("entry_count") >= min_entries) & (F.col("ci95_lower") > 0))
    best = F.max_by(
        F.struct("threshold", "entry_count", "realized_ev_per_share", "ci95_lower"),
        F.struct("ci95_lower", "realized_ev_per_share", -F.col("threshold")),
    )
    return ok.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def entry_diagnostics(entries: DataFrame, *, by: Sequence[str], age: str, width: float) -> DataFrame:
    """Count, and median, 95th percentile and maximum of the quote age."""
    sides = entries.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max(age).alias("age_max"))
    q = quantiles(entries, list(by), age, {"age_median": 0.5, "age_p95": 0.95}, width)
    return sides.join(q, list(by))


# ---------------------------------------------------------------- gates and selection

def direction_gate(evidence: DataFrame, bands: DataFrame) -> DataFrame:
    """Failed conditions of a direction model, in a fixed order; bands add theirs once each."""
    lim = DIRECTION_LIMITS
    worst = bands.agg(
        F.max(F.col("effective_market_count") < lim["bin_samples"]).alias("__few"),
        F.max(F.col("calibration_error") > lim["bin_error"]).alias("__off"),
    )
    c = F.col
    checks = [
        (c("sealed_holdout_markets") < lim["holdout_markets"], "insufficient_sealed_holdout_markets"),
        (c("log_loss_improvement") < lim["log_loss_improvement"], "log_loss_improvement_below_threshold"),
        (c("log_loss_ci_lower") <= 0, "log_loss_ci_lower_not_positive"),
        (c("brier_improvement") < lim["brier_improvement"], "brier_improvement_below_threshold"),
        (c("brier_ci_lower") <= 0, "brier_ci_lower_not_positive"),
        (~c("calibration_slope").between(lim["slope_min"], lim["slope_max"]), "calibration_slope_out_of_range"),
        (c("__few"), "target_bin_insufficient_samples"),
        (c("__off"), "target_bin_calibration_error_exceeds_limit"),
    ]
    return _decide(beside(evidence, worst), checks).drop("__few", "__off")


def maker_gate(evidence: DataFrame) -> DataFrame:
    """Failed conditions of a maker run."""
    lim, c = MAKER_LIMITS, F.col
    checks = [
        (c("total_fills") < lim["total_fills"], "insufficient_total_fills"),
        (c("up_fills") < lim["side_fills"], "insufficient_up_fills"),
        (c("down_fills") < lim["side_fills"], "insufficient_down_fills"),
        (c("net_ev_per_filled_share") < lim["net_ev_per_share"], "net_ev_per_share_below_threshold"),
        (c("net_ev_ci_lower") <= 0, "net_ev_ci_lower_not_positive"),
        (c("pnl_without_top_one_percent") <= 0, "top_one_percent_removal_not_positive"),
        (c("positive_week_ratio") < lim["positive_week_ratio"], "insufficient_positive_test_weeks"),
        (c("largest_month_pnl_share") > lim["month_pnl_share"], "single_month_pnl_concentration"),
        (c("capacity_net_edge_ci_lower") <= 0, "capacity_ci_lower_not_positive"),
        (~c("rebate_free"), "rebate_free_requirement_failed"),
        (~c("pessimistic_queue"), "pessimistic_queue_requirement_failed"),
        (~c("p99_latency"), "p99_latency_requirement_failed"),
        (~c("trade_order_robust"), "trade_ordering_not_robust"),
    ]
    return _decide(evidence, checks)


def mispricing_gate(evidence: DataFrame) -> DataFrame:
    return _decide(
        evidence, [(F.col("paired_net_edge_ci_lower") <= 0, "paired_net_edge_ci_lower_must_be_positive")]
    )


def _decide(df: DataFrame, checks: Sequence[tuple[Column, str]]) -> DataFrame:
    failed = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in checks]))
    return df.withColumn("failed_conditions", failed).withColumn("accepted", F.size("failed_conditions") == 0)


def select_candidate(candidates: DataFrame, *, baseline_kind: str = "logistic", challenger_kind: str = "lightgbm") -> DataFrame:
    """Best baseline by (log loss, Brier, calibration error, name), replaced only by a challenger that
    beats it on all three and whose paired intervals against it are above zero."""
    rank = F.struct("log_loss", "brier", "calibration_error", "name")
    best = candidates.filter(F.col("kind") == baseline_kind).agg(F.min_by(F.struct("*"), rank).alias("best"))
    # Baselines stay in the rows, so that a result exists without any challenger.
    pairs = beside(candidates.filter(F.col("kind").isin(baseline_kind, challenger_kind)), best)
    wins = (
        (F.col("kind") == challenger_kind)
        & (F.col("log_loss") < F.col("best.log_loss"))
        & (F.col("brier") < F.col("best.brier"))
        & (F.col("calibration_error") < F.col("best.calibration_error"))
        & (F.col("paired_baseline") == F.col("best.name"))
        & (F.col("log_loss_ci_lower") > 0)
        & (F.col("brier_ci_lower") > 0)
    )
    out = pairs.groupBy(F.col("best.name").alias("best_logistic_name")).agg(
        F.min_by("name", F.when(wins, rank)).alias("__winner")
    )
    return out.select(
        F.coalesce("__winner", "best_logistic_name").alias("selected_name"),
        "best_logistic_name",
        F.when(F.col("__winner").isNull(), f"no_{challenger_kind}_candidate_met_replacement_rule")
        .otherwise(f"{challenger_kind}_met_replacement_rule")
        .alias("reason"),
    )


def exclusion_counts(markets: DataFrame, *, reason: str) -> DataFrame:
    """Markets per exclusion reason; NULL means included."""
    return markets.groupBy(F.coalesce(F.col(reason), F.lit("included")).alias("reason")).agg(
        F.count(F.lit(1)).alias("markets")
    )

