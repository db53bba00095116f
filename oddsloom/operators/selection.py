"""Rankings, samples, grids, coverage and job pruning."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.functions.integers import floor_div, floor_to
from oddsloom.operators.timeline import (
    Timeline,
    before,
    previous,
    running_count,
    scan,
    whole_max,
    whole_min,
    whole_sum,
)
from oddsloom.session import DAY_NS, HOUR_NS, settle


def trade_window_analysis(
    trades: DataFrame, markets: DataFrame, *, market: str, token: str, ts: str, tie: Sequence[str], price: str,
    entry_price: float, lookback_ns: int, width: int,
) -> DataFrame:
    """First, highest and last price and counts in a market's window and its active part, and the
    first upward crossing of `entry_price`. `markets` carries `activation_start` and `window_end`."""
    rows = scan(trades, Timeline.of([market, token], [ts, *tie], width), {"__was": previous(F.struct(F.col(price).alias("p"), F.col(ts).alias("t")))})
    rows = rows.join(markets.select(market, "activation_start", "window_end"), market)
    t, p = F.col(ts), F.col(price)
    start = F.col("window_end") - lookback_ns
    rows = rows.filter((t >= start) & (t <= F.col("window_end")))
    active = F.col("activation_start").isNull() | (t >= F.col("activation_start"))
    crossed = active & (F.col("__was.t") >= start) & (F.col("__was.p") < entry_price) & (p >= entry_price)
    rank = F.struct(ts, *tie)
    when_active = F.when(active, rank)
    return rows.groupBy(market, token).agg(
        F.count(F.lit(1)).alias("window_trades"),
        F.min_by(price, rank).alias("first_window_price"),
        F.max(p).alias("max_window_price"),
        F.max_by(price, rank).alias("last_window_price"),
        F.count(F.when(active, 1)).alias("activation_trades"),
        F.min_by(price, when_active).alias("first_activation_price"),
        F.max(F.when(active, p)).alias("max_activation_price"),
        F.max_by(price, when_active).alias("last_activation_price"),
        F.min(F.when(crossed, t)).alias("entry_cross_ts"),
    )


def best_token(analysis: DataFrame, *, market: str, token: str, volume: str) -> DataFrame:
    """Per market: the earliest crossing (then most active trades, then volume), else the highest
    active price (then trades, then volume)."""
    crossed = F.col("entry_cross_ts").isNotNull()
    rank = F.struct(
        crossed.cast("int").alias("c"),
        F.when(crossed, -F.col("entry_cross_ts")).alias("early"),
        F.when(~crossed, F.coalesce("max_activation_price", F.lit(0.0))).alias("high"),
        F.col("activation_trades"),
        F.coalesce(F.col(volume), F.lit(0.0)),
        (-F.col(token)).alias("first_token"),
    )
    return analysis.groupBy(market).agg(F.max_by(F.struct(*analysis.columns), rank).alias("r")).select("r.*")


def breakout_per_game(analysis: DataFrame, *, event: str, market: str, volume: str, limit: int | None = None) -> DataFrame:
    """One market per event of two or more: earliest crossing or cheapest opener; with its opponent."""
    crossed = F.col("entry_cross_ts").isNotNull()
    vol = F.coalesce(F.col(volume), F.lit(0.0))
    rank = F.struct(
        (~crossed).cast("int"), F.when(crossed, F.col("entry_cross_ts")), F.when(~crossed, F.coalesce("first_window_price", F.lit(1.0))),
        -vol, F.col(market),
    )
    opener = F.struct(F.coalesce("first_window_price", F.lit(0.0)), -F.col(market))
    out = analysis.filter("window_trades > 0").groupBy(event).agg(
        F.count(F.lit(1)).alias("__n"),
        F.min_by(F.struct(market, "entry_cross_ts", "first_window_price"), rank).alias("r"),
        F.max_by(F.struct(market, "first_window_price"), opener).alias("o"),
        F.sum(vol).alias("event_total_volume"),
    ).filter("__n >= 2")
    out = out.select(
        event, "r.*", F.col(f"o.{market}").alias("opponent"), F.col("o.first_window_price").alias("opponent_first_window_price"),
        "event_total_volume",
    )
    return out if limit is None else out.orderBy(F.desc("event_total_volume"), event).limit(limit)


def display_markets(prices: DataFrame, fills: DataFrame, *, market: str, price: str, limit: int) -> DataFrame:
    """Traded markets first, then the widest price range; a limit is the feature here."""
    ranges = prices.groupBy(market).agg((F.max(price) - F.min(price)).alias("price_range"))
    traded = fills.select(market).distinct().withColumn("traded", F.lit(1))
    out = ranges.join(traded, market, "left").withColumn("traded", F.coalesce("traded", F.lit(0)))
    return out.orderBy(F.desc("traded"), F.desc("price_range"), market).limit(limit)


def downsample(
    series: DataFrame, *, keys: Sequence[str], order: Sequence[str], value: str, max_points: int, width: int,
    keep: Column | None = None,
) -> DataFrame:
    """At most about `max_points` rows per key: every stride-th row plus first, last, lowest, highest
    and those marked by `keep`; the stride is widened once more if the marked rows overflow."""
    line = Timeline.of(keys, order, width)
    marked = F.coalesce(keep, F.lit(False)) if keep is not None else F.lit(False)
    v, place = F.col(value), F.struct(*order)
    back = F.struct(*[(-F.col(c)).alias(c) for c in order])
    rows = settle(
        scan(
            series.withColumn("__keep", marked),
            line,
            {
                "__pos": before(running_count()),
                "__n": whole_sum(F.lit(1).cast("bigint")),
                "__low": whole_min(F.struct(v.alias("v"), place.alias("at"))),
                "__high": whole_max(F.struct(v.alias("v"), back.alias("at"))),
            },
        )
    )
    pos, n = F.col("__pos"), F.col("__n")
    must = (
        F.col("__keep") | (pos == 0) | (pos == n - 1) | (place == F.col("__low.at")) | (back == F.col("__high.at"))
    )
    rows = rows.withColumn("__must", must)
    counted = scan(rows, line, {"__m": whole_sum(F.col("__must").cast("bigint"))}, hold=True)
    m = F.col("__m")
    budget = F.greatest(F.lit(100).cast("bigint"), F.lit(max_points) - m)
    counted = counted.withColumn("__stride", F.greatest(F.lit(1).cast("bigint"), floor_div(n, budget)))
    stride = F.col("__stride")
    on = F.pmod(pos, stride) == 0
    sizes = scan(counted, line, {"__off": whole_sum((F.col("__must") & ~on).cast("bigint"))})
    strided = floor_div(n - 1, stride) + 1
    left = F.lit(max_points) - m
    second = F.when(
        left > 0, F.greatest(F.lit(1).cast("bigint"), floor_div(strided, F.greatest(left, F.lit(1).cast("bigint"))))
    ).otherwise(n)
    chosen = (
        F.when(n <= max_points, True)
        .when(strided + F.col("__off") > max_points, F.col("__must") | (F.pmod(pos, stride * second) == 0))
        .otherwise(F.col("__must") | on)
    )
    return sizes.filter(chosen).select(*series.columns, F.col("__pos").alias("bar"))


def last_per_bucket(points: DataFrame, *, keys: Sequence[str], ts: str, tie: Sequence[str], value: str, bucket_ns: int) -> DataFrame:
    """Last value per time bucket; empty buckets do not appear."""
    return points.groupBy(*keys, floor_to(ts, bucket_ns).alias("bucket_ts")).agg(
        F.max_by(value, F.struct(ts, *tie)).alias(value)
    )


def grid_subset(grid: DataFrame, *, columns: Sequence[str], seed: int, limit: int) -> DataFrame:
    """A fixed-size subset of a grid in the order of a seeded hash; the sample size is the feature."""
    text = F.concat(F.lit(f"{seed}:"), F.to_json(F.struct(*sorted(columns))))
    return grid.orderBy(F.md5(text)).limit(limit)


def parameter_grid(base: DataFrame, values: Mapping[str, Sequence]) -> DataFrame:
    """Every combination of the literal values for each row of `base`, one row per canonical JSON."""
    out = base
    for name, options in values.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in options])))
    names = sorted([*base.columns, *values])
    return out.withColumn("params", F.to_json(F.struct(*names))).dropDuplicates(["params"])


def trial_scores(
    df: DataFrame, *, initial_cash: float, min_fills: int
) -> Column:
    """Profit minus half the drawdown and the penalties for early ends, thin coverage and few fills."""
    return (
        F.col("pnl")
        - 0.5 * F.col("max_drawdown")
        - F.when(F.col("terminated_early"), initial_cash).otherwise(0.0)
        - initial_cash * F.greatest(F.lit(0.0), 0.98 - F.col("coverage")) * 10.0
        - F.when(F.col("fills") < min_fills, 2.0).otherwise(0.0)
    )


def leaderboard(evaluations: DataFrame, *, trial: str, split: str = "split") -> DataFrame:
    """Medians per trial over its train and holdout windows, in final order.

    A trial has a handful of windows, so an exact median per trial is bounded. Holdout medians are
    NULL for trials never promoted; those come after all promoted ones.
    """
    made = []
    for metric in ("score", "pnl", "max_drawdown", "fills", "coverage"):
        for part in ("train", "holdout"):
            made.append(
                F.median(F.when(F.col(split) == part, F.col(metric).cast("double"))).alias(f"{part}_median_{metric}")
            )
    return evaluations.groupBy(trial).agg(*made)


def ranked(board: DataFrame, *, trial: str) -> DataFrame:
    return board.orderBy(
        F.col("holdout_median_score").isNull(), F.desc("holdout_median_score"), F.desc("train_median_score"), trial
    )


def promoted(board: DataFrame, *, trial: str, k: int) -> DataFrame:
    """The k best trials on training windows; k is the feature."""
    return board.orderBy(F.desc("train_median_score"), trial).limit(k)


def window_coverage(df: DataFrame, *, start: str, end: str, through: str) -> Column:
    """Share of the requested window that was simulated; 1 or 0 for empty windows, NULL if unknown."""
    clamped = F.least(F.greatest(F.col(through), F.col(start)), F.col(end))
    ratio = (clamped - F.col(start)) / (F.col(end) - F.col(start))
    return F.when(F.col(start).isNull() | F.col(end).isNull(), None).when(
        F.col(end) <= F.col(start), F.when(F.col(through).isNotNull(), 1.0).otherwise(0.0)
    ).when(F.col(through).isNotNull(), ratio)


def replay_validity(records: DataFrame, *, key: str, price: str, min_records: int, min_range: float) -> DataFrame:
    """Record count and price range per key, and whether both suffice."""
    out = records.groupBy(key).agg(F.count(F.lit(1)).alias("records"), (F.max(price) - F.min(price)).alias("price_range"))
    return out.withColumn("valid", (F.col("records") >= min_records) & (F.col("price_range") >= min_range))


def token_coverage(
    books: DataFrame, trades: DataFrame, tokens: DataFrame, *, token: str, ts: str, start: int, end: int
) -> DataFrame:
    """Book and trade counts and hours without any book row per token; eligible without gaps."""
    count = lambda df, name: df.filter(F.col(ts).between(start, end)).groupBy(token).agg(F.count(F.lit(1)).alias(name))
    hours = (
        books.filter(F.col(ts).between(start, end))
        .select(token, floor_div(ts, HOUR_NS).alias("h"))
        .distinct()
        .groupBy(token)
        .agg(F.count(F.lit(1)).alias("__hours"))
    )
    expected = end // HOUR_NS - start // HOUR_NS + 1
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    out = tokens.join(count(books, "__b"), token, "left").join(count(trades, "__t"), token, "left").join(hours, token, "left")
    return out.select(
        token, zero(F.col("__b")).alias("book_rows"), zero(F.col("__t")).alias("trade_rows"),
        (F.lit(expected) - zero(F.col("__hours"))).cast("bigint").alias("gap_hours"),
    ).withColumn("eligible", (F.col("book_rows") > 0) & (F.col("trade_rows") > 0) & (F.col("gap_hours") == 0))


def prune_jobs(jobs: DataFrame, manifest: DataFrame, *, keys: Sequence[str], now: Column, recheck_after_ns: int | None) -> DataFrame:
    """Jobs without a completed entry and without a recent empty one."""
    fresh = F.lit(True) if recheck_after_ns is None else F.col("checked_at") > now - recheck_after_ns
    done = manifest.filter((F.col("status") == "completed") | ((F.col("status") == "empty") & fresh)).select(*keys)
    return jobs.join(done, list(keys), "left_anti")


def catalog_days(catalog: DataFrame, *, start: str, end: str, window_start: int, window_end: int) -> DataFrame:
    """One row per catalog entry and UTC day of its range inside the window."""
    first = F.greatest(floor_div(start, DAY_NS), F.lit(window_start // DAY_NS))
    last = F.least(floor_div(end, DAY_NS), F.lit(window_end // DAY_NS))
    return catalog.filter(first <= last).withColumn("day", F.explode(F.sequence(first, last)))




def parameter_search(
    params: DataFrame,
    evaluate: Callable[[DataFrame, str], DataFrame],
    *,
    trial: str,
    initial_cash: float,
    min_fills: int,
    top_k: int,
) -> DataFrame:
    """Evaluate all trials on training windows, promote the best to the holdout windows, rank.

    `evaluate(params, split)` returns one row per trial and window with pnl, max_drawdown, fills,
    coverage and terminated_early. It gets the whole parameter table at once, so a signal family is
    one plan over parameters x windows x prices, not a job per trial.
    """

    def scored(rows: DataFrame, split: str) -> DataFrame:
        out = rows.withColumn("split", F.lit(split))
        return out.withColumn("score", trial_scores(out, initial_cash=initial_cash, min_fills=min_fills))

    train = settle(scored(evaluate(params, "train"), "train"))
    best = promoted(leaderboard(train, trial=trial), trial=trial, k=top_k).select(trial)
    holdout = scored(evaluate(params.join(best, trial, "left_semi"), "holdout"), "holdout")
    return ranked(leaderboard(train.unionByName(holdout), trial=trial), trial=trial)
