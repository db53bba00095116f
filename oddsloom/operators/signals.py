"""Entry conditions as columns on price and book tables; no positions, no orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.operators.timeline import (
    Timeline,
    before,
    linear_recurrence,
    number,
    previous,
    row_frames,
    running_max,
    scan,
    whole_sum,
)
from oddsloom.session import HOUR_NS

LEVELS = "array<struct<price:double,size:double>>"
GAP_WARNING_NS = 4 * HOUR_NS


def crossings(prices: DataFrame, *, keys: Sequence[str], order: Sequence[str], price: str, level: Column, width: int) -> DataFrame:
    """Rows whose price reaches the level from below: previous < level <= current."""
    out = scan(prices, Timeline.of(keys, order, width), {"__was": previous(F.col(price))})
    return out.withColumn(
        "crossed", F.coalesce((F.col("__was") < level) & (F.col(price) >= level), F.lit(False))
    ).drop("__was")


def first_crossing(
    prices: DataFrame, *, keys: Sequence[str], order: Sequence[str], price: str, level: Column, width: int,
    active_from: Column | None = None, active_until: Column | None = None,
) -> DataFrame:
    """Each key's first upward crossing inside its active span; the previous price may precede it."""
    rows = crossings(prices, keys=keys, order=order, price=price, level=level, width=width).filter("crossed")
    ts = F.col(order[0])
    if active_from is not None:
        rows = rows.filter(ts >= active_from)
    if active_until is not None:
        rows = rows.filter(ts <= active_until)
    return first_match(rows, keys=keys, order=order)


def first_match(rows: DataFrame, *, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each key's earliest row."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def prior_frames(
    prices: DataFrame, *, keys: Sequence[str], order: Sequence[str], n: int, width: int, outs, also=None,
) -> DataFrame:
    """Aggregates over the n rows before each row, NULL until n rows exist; `outs` name -> f(frame)."""
    placed = number(prices, Timeline.of(keys, order, width), "__pos")
    made = {name: (lambda spec, f=f: f(spec.rowsBetween(-n, -1))) for name, f in outs.items()}
    extra = dict(also or {})
    framed = row_frames(placed, keys, "__pos", n, {**made, **extra})
    return framed.withColumns(
        {name: F.when(F.col("__pos") >= n, F.col(name)) for name in outs}
    ).drop("__pos")


def breakout(
    prices: DataFrame, *, keys, order, price: str, window: int, k: float, buffer: float, max_price: float, width: int,
    fresh_cross: bool = True,
) -> DataFrame:
    """Price at or above mean + k * sample deviation + buffer of the prior rows, newly crossed."""
    p = F.col(price)
    out = prior_frames(
        prices, keys=keys, order=order, n=window, width=width,
        outs={"__mean": lambda f: F.avg(p).over(f), "__std": lambda f: F.stddev_samp(p).over(f)},
        also={"__was": lambda s: F.lag(p).over(s)},
    )
    out = out.withColumn("breakout_level", F.col("__mean") + k * F.coalesce("__std", F.lit(0.0)) + buffer)
    hit = (p >= F.col("breakout_level")) & (p <= max_price)
    if fresh_cross:
        hit = hit & (F.col("__was") < F.col("breakout_level"))
    return out.withColumn("signal", F.coalesce(hit, F.lit(False))).drop("__mean", "__std", "__was")


def mean_reversion(prices: DataFrame, *, keys, order, price: str, window: int, threshold: float, width: int) -> DataFrame:
    p = F.col(price)
    out = prior_frames(
        prices, keys=keys, order=order, n=window, width=width, outs={"rolling_mean": lambda f: F.avg(p).over(f)}
    )
    return out.withColumn("signal", F.coalesce(p <= F.col("rolling_mean") - threshold, F.lit(False)))


def vwap_reversion(
    ticks: DataFrame, *, keys, order, price: str, size: str, window: int, min_size: float, threshold: float, width: int
) -> DataFrame:
    """Price below the size-weighted mean of the prior ticks; ticks under `min_size` do not count."""
    p, s = F.col(price), F.col(size)
    out = prior_frames(
        ticks.filter(s >= min_size), keys=keys, order=order, n=window, width=width,
        outs={"__ps": lambda f: F.sum(p * s).over(f), "__s": lambda f: F.sum(s).over(f)},
    )
    out = out.withColumn("vwap", F.when(F.col("__s") > 0, F.col("__ps") / F.col("__s")))
    return out.withColumn("signal", F.coalesce(p <= F.col("vwap") - threshold, F.lit(False))).drop("__ps", "__s")


def panic_drop(
    prices: DataFrame, *, keys, order, price: str, window: int, min_drop: float, panic_price: float, width: int
) -> DataFrame:
    p = F.col(price)
    out = prior_frames(
        prices, keys=keys, order=order, n=window, width=width, outs={"peak": lambda f: F.max(p).over(f)}
    )
    return out.withColumn(
        "signal", F.coalesce((F.col("peak") - p >= min_drop) & (p <= panic_price), F.lit(False))
    )


def rolling_forecast(prices: DataFrame, *, keys, order, price: str, window: int, width: int) -> DataFrame:
    """Mean of the last `window` prices including the current one, clipped to [0, 1]; only full windows."""
    p = F.col(price)
    placed = number(prices, Timeline.of(keys, order, width), "__pos")
    framed = row_frames(
        placed, keys, "__pos", window - 1,
        {"forecast": lambda s: F.avg(p).over(s.rowsBetween(-(window - 1), 0))},
    )
    return framed.filter(F.col("__pos") >= window - 1).withColumn(
        "forecast", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("forecast")))
    ).drop("__pos")


def fixed_rolling_sharpe(
    returns: DataFrame, *, keys, order, ret: str, window: int, periods_per_year: float, width: int
) -> DataFrame:
    r = F.col(ret)
    placed = number(returns, Timeline.of(keys, order, width), "__pos")
    frame = lambda s: s.rowsBetween(-(window - 1), 0)
    framed = row_frames(
        placed, keys, "__pos", window - 1,
        {
            "__m": lambda s: F.avg(r).over(frame(s)),
            "__s": lambda s: F.stddev_samp(r).over(frame(s)),
            "__n": lambda s: F.count(r).over(frame(s)),
        },
    )
    ok = (F.col("__n") == window) & (F.col("__s") > 0)
    return framed.withColumn(
        "sharpe", F.when(ok, F.col("__m") / F.col("__s") * float(periods_per_year) ** 0.5)
    ).drop("__pos", "__m", "__s", "__n")


def brier_advantage(
    series: DataFrame, *, keys, order, user: str, market: str, outcome: str, width: int, clamp: bool = True, drop: bool = True
) -> DataFrame:
    """Market Brier minus user Brier per row, and its running sum. Without `clamp`, forecasts outside [0, 1] are scored as they are;
    without `drop`, rows that lack a value stay, their advantage null (NaN for a NaN)."""
    within = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)) if clamp else c
    unit = lambda c: within(F.col(c).cast("double"))
    u, m, y = unit(user), unit(market), unit(outcome)
    kept = series.dropna(how="any", subset=[user, market, outcome]) if drop else series
    rows = kept.withColumn(
        "brier_advantage", (m - y) * (m - y) - (u - y) * (u - y)
    )
    from oddsloom.operators.timeline import running_sum

    return scan(
        rows, Timeline.of(keys, order, width), {"cumulative_brier_advantage": running_sum(F.col("brier_advantage"))}
    )


# ---------------------------------------------------------------- recursive indicators

def ema_crossover(
    prices: DataFrame, *, keys: Sequence[str], order: Sequence[str], price: str, fast: int, slow: int, buffer: float,
    width: int, rows_per_chunk: int = 100_000,
) -> DataFrame:
    """Fast and slow EMA from the first row after both seeds exist.

    Each is seeded with the mean of its first `period` prices; both start to move at the first price
    after the slow seed.
    """
    p = F.col(price)
    line = Timeline.of(keys, order, width)
    placed = number(prices, line, "__pos", hold=True)
    seeded = scan(
        placed,
        line,
        {
            "__fast": whole_sum(F.when(F.col("__pos") < fast, p)),
            "__slow": whole_sum(F.when(F.col("__pos") < slow, p)),
        },
    ).filter(F.col("__pos") >= slow - 1)
    start = F.col("__pos") == slow - 1
    fed = seeded.withColumns(
        {
            "__xf": F.when(start, F.col("__fast") / fast).otherwise(p),
            "__xs": F.when(start, F.col("__slow") / slow).otherwise(p),
            "__i": F.col("__pos") - (slow - 1),
        }
    )
    out = linear_recurrence(
        fed, list(keys), "__i",
        {"fast_ema": ("__xf", 2.0 / (fast + 1.0)), "slow_ema": ("__xs", 2.0 / (slow + 1.0))}, rows_per_chunk,
    ).filter("__i > 0")
    return out.withColumn("signal", F.col("fast_ema") >= F.col("slow_ema") + buffer).drop(
        "__pos", "__fast", "__slow", "__xf", "__xs", "__i"
    )


def rsi(
    prices: DataFrame, *, keys: Sequence[str], order: Sequence[str], price: str, period: int, width: int,
    rows_per_chunk: int = 100_000,
) -> DataFrame:
    """Wilder's RSI: mean of the first `period` changes, then smoothed; 100 without losses."""
    line = Timeline.of(keys, order, width)
    moved = scan(prices, line, {"__was": previous(F.col(price)), "__pos": before_count()}, hold=True)
    change = F.col(price) - F.col("__was")
    moved = moved.withColumns(
        {"__gain": F.greatest(change, F.lit(0.0)), "__loss": F.greatest(-change, F.lit(0.0))}
    )
    early = F.col("__pos").between(1, period)
    seeded = scan(
        moved,
        line,
        {"__g0": whole_sum(F.when(early, F.col("__gain"))), "__l0": whole_sum(F.when(early, F.col("__loss")))},
    ).filter(F.col("__pos") >= period)
    start = F.col("__pos") == period
    fed = seeded.withColumns(
        {
            "__xg": F.when(start, F.col("__g0") / period).otherwise(F.col("__gain")),
            "__xl": F.when(start, F.col("__l0") / period).otherwise(F.col("__loss")),
            "__i": F.col("__pos") - period,
        }
    )
    out = linear_recurrence(
        fed, list(keys), "__i", {"__ag": ("__xg", 1.0 / period), "__al": ("__xl", 1.0 / period)}, rows_per_chunk
    )
    value = F.when(F.col("__al") == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + F.col("__ag") / F.col("__al")))
    return out.withColumn("rsi", value).drop(
        "__was", "__pos", "__gain", "__loss", "__g0", "__l0", "__xg", "__xl", "__i", "__ag", "__al"
    )


def before_count():
    from oddsloom.operators.timeline import running_count

    return before(running_count())


# ---------------------------------------------------------------- gates on time and price

def final_period_entries(
    prices: DataFrame, *, keys, order, price: str, close_ts: str, final_ns: int, level: float, width: int
) -> DataFrame:
    """First upward crossing inside the last `final_ns` before the close."""
    start = F.greatest(F.lit(0), F.col(close_ts) - final_ns)
    known = F.col(close_ts) > 0
    return first_crossing(
        prices, keys=keys, order=order, price=price, level=F.lit(level), width=width,
        active_from=F.when(known, start), active_until=F.when(known, F.col(close_ts)),
    )


def late_favorites(prices: DataFrame, *, keys, order, price: str, level: float, active_from: Column, active_until: Column) -> DataFrame:
    """First price at or above the level inside the active span."""
    ts = F.col(order[0])
    rows = prices.filter((ts >= active_from) & (ts <= active_until) & (F.col(price) >= level))
    return first_match(rows, keys=keys, order=order)


def deep_values(prices: DataFrame, *, keys, order, price: str, ceiling: float) -> DataFrame:
    """First price at or below the ceiling."""
    return first_match(prices.filter(F.col(price) <= ceiling), keys=keys, order=order)


# ---------------------------------------------------------------- books

def average_entry(levels: Column, quantity: Column) -> Column:
    """Average price of taking `quantity` from the levels in order; NULL on an empty side."""
    start = F.struct(quantity.cast("double").alias("left"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("got"))
    step = lambda acc, l: F.struct(
        F.greatest(acc["left"] - l["size"], F.lit(0.0)).alias("left"),
        (acc["cost"] + F.least(acc["left"], l["size"]) * l["price"]).alias("cost"),
        (acc["got"] + F.least(acc["left"], l["size"])).alias("got"),
    )
    return F.aggregate(levels, start, step, lambda acc: F.when(acc["got"] > 0, acc["cost"] / acc["got"]))


def depth(levels: Column, k: int) -> Column:
    return F.aggregate(F.slice(levels, 1, k), F.lit(0.0), lambda acc, l: acc + F.greatest(l["size"], F.lit(0.0)))


def book_pressure(
    books: DataFrame, *, bids: str, asks: str, k: int, trade_size: float, max_price: float, max_spread: float,
    min_imbalance: float, min_edge: float, max_slippage: float,
) -> DataFrame:
    """Depth imbalance over the top k levels and microprice edge, with spread, price and slippage gates."""
    B, A = F.col(bids), F.col(asks)
    out = books.withColumns({"bid": F.get(B, 0)["price"], "ask": F.get(A, 0)["price"], "__bs": F.get(B, 0)["size"], "__as": F.get(A, 0)["size"]})
    out = out.filter("ask > bid AND __bs > 0 AND __as > 0")
    mid = (F.col("bid") + F.col("ask")) / 2
    micro = (F.col("ask") * F.col("__bs") + F.col("bid") * F.col("__as")) / (F.col("__bs") + F.col("__as"))
    db, da = depth(B, k), depth(A, k)
    out = out.withColumns(
        {
            "imbalance": db / (db + da),
            "microprice_edge": micro - mid,
            "spread": F.col("ask") - F.col("bid"),
            "expected_entry": F.coalesce(average_entry(A, F.lit(float(trade_size))), F.col("ask")),
        }
    )
    ok = (
        (F.col("expected_entry") <= max_price)
        & (F.col("spread") <= max_spread)
        & (F.col("imbalance") >= min_imbalance)
        & (F.col("microprice_edge") >= min_edge)
        & (F.col("expected_entry") - F.col("ask") <= max_slippage)
    )
    return out.withColumn("signal", ok).drop("__bs", "__as")


def pair_arbitrage(
    pairs: DataFrame, *, size: float, fee_rate: Column, max_leg: float, max_spread: float, min_size: float,
    min_edge: float, max_slippage: float,
) -> DataFrame:
    """Edge of buying both legs: 1 - (average prices + fees), with price, spread and size gates.

    Input: `asks_a`, `asks_b` (levels), `bid_a`, `bid_b`.
    """
    legs = {}
    for leg in "ab":
        top = F.get(F.col(f"asks_{leg}"), 0)
        legs[f"ask_{leg}"], legs[f"ask_size_{leg}"] = top["price"], top["size"]
    out = pairs.withColumns(legs).filter("ask_a IS NOT NULL AND ask_b IS NOT NULL")
    want = F.least(F.lit(float(size)), F.col("ask_size_a"), F.col("ask_size_b"))
    out = out.withColumn("desired", want).withColumns(
        {f"price_{leg}": average_entry(F.col(f"asks_{leg}"), F.col("desired")) for leg in "ab"}
    )
    fee = lambda p: fee_rate * p * (1 - p)
    cost = sum((F.col(f"price_{leg}") + fee(F.col(f"price_{leg}")) for leg in "ab"), F.lit(0.0))
    ok = F.lit(True)
    for leg in "ab":
        ok = (
            ok
            & (F.col(f"ask_{leg}") <= max_leg)
            & (F.col(f"ask_{leg}") - F.col(f"bid_{leg}") <= max_spread)
            & (F.col(f"ask_size_{leg}") >= min_size)
            & (F.col(f"price_{leg}") - F.col(f"ask_{leg}") <= max_slippage)
        )
    return out.withColumn("edge", 1 - cost).withColumn("signal", ok & (F.col("edge") >= min_edge))


def passive_ladder(
    df: DataFrame, *, p_up: str, tick: str, fee: float, buffer: float, minimum_edge: float, offsets: Sequence[int],
    allocations: Sequence[float], max_shares: float, p_market: str,
) -> DataFrame:
    """Passive bid ladder on the side with the best net edge.

    Input books: `up_bid`, `up_ask`, `down_bid`, `down_ask`. Layers are snapped down to the tick, kept
    inside (0, ask), at most fair - fee - buffer - edge, one per price.
    """
    sides = F.array(
        *[
            F.struct(
                F.lit(side).alias("side"),
                (F.col(p_up) if side == "up" else 1 - F.col(p_up)).alias("fair"),
                (F.col(p_market) if side == "up" else 1 - F.col(p_market)).alias("market"),
                F.col(f"{side}_bid").alias("bid"),
                F.col(f"{side}_ask").alias("ask"),
            )
            for side in ("up", "down")
        ]
    )
    rungs = F.array(
        *[F.struct(F.lit(int(o)).alias("offset"), F.lit(float(a)).alias("share")) for o, a in zip(offsets, allocations)]
    )
    T = F.col(tick)
    wide = df.withColumn("__s", F.explode(sides))
    layer = lambda r: F.struct(
        F.round(F.floor((F.col("__s.bid") - r["offset"] * T + 1e-12) / T) * T, 12).alias("price"),
        (F.lit(float(max_shares)) * r["share"]).alias("size"),
    )
    ceiling = F.col("__s.fair") - fee - buffer - minimum_edge
    laid = wide.withColumn(
        "layers",
        F.filter(
            F.transform(rungs, layer),
            lambda l: (l["price"] > 0) & (l["price"] < F.col("__s.ask")) & (l["price"] <= ceiling + 1e-12) & (l["size"] > 0),
        ),
    )
    # Prices never rise along the ladder, so equal prices are neighbours; the first of them stays.
    once = F.filter(
        "layers",
        lambda l, i: (i == 0) | (F.get(F.col("layers"), i - 1)["price"] != l["price"]),
    )
    laid = laid.withColumn("layers", once).filter(F.size("layers") > 0)
    net = F.col("__s.fair") - F.get(F.col("layers"), 0)["price"] - fee - buffer
    plan = F.struct(
        net.alias("net_edge"), (F.col("__s.fair") - F.col("__s.market")).alias("model_edge"),
        F.col("__s.side").alias("side"), "layers",
    )
    keys = df.columns
    return laid.groupBy(*keys).agg(
        F.max_by(plan, F.struct(net, F.col("__s.fair") - F.col("__s.market"), F.col("__s.side"))).alias("p")
    ).select(*keys, "p.*")


# ---------------------------------------------------------------- record continuity

def largest_gaps(records: DataFrame, *, keys, order, width: int, warn_ns: int = GAP_WARNING_NS) -> DataFrame:
    """Largest distance between neighbouring records per key, and whether it needs a warning."""
    ts = order[0]
    out = scan(records, Timeline.of(keys, order, width), {"__was": previous(F.col(ts))})
    return out.groupBy(*keys).agg(F.max(F.col(ts) - F.col("__was")).alias("largest_gap")).withColumn(
        "warn", F.coalesce(F.col("largest_gap") > warn_ns, F.lit(False))
    )


def epoch_gaps(records: DataFrame, *, keys, order, epoch: str, width: int, fail: bool = True) -> DataFrame:
    """Marks rows that start a new epoch; a falling epoch fails the job (or is marked with `fail=False`)."""
    out = scan(records, Timeline.of(keys, order, width), {"__was": previous(F.col(epoch))})
    back = F.coalesce(F.col(epoch) < F.col("__was"), F.lit(False))
    gap = F.coalesce(F.col(epoch) > F.col("__was"), F.lit(False))
    if fail:
        gap = F.when(back, F.raise_error(F.lit("epoch went backwards")).cast("boolean")).otherwise(gap)
    return out.withColumns({"gap": gap, "regressed": back}).drop("__was")


def sequence_audit(updates: DataFrame, *, keys, order, first_id: str, final_id: str, width: int) -> DataFrame:
    """stale (already covered), gap (ids skipped) or applied, against the highest final id so far."""
    out = scan(updates, Timeline.of(keys, order, width), {"__top": before(running_max(F.col(final_id)))})
    status = (
        F.when(F.col("__top").isNull(), "applied")
        .when(F.col(final_id) <= F.col("__top"), "stale")
        .when(F.col(first_id) > F.col("__top") + 1, "gap")
        .otherwise("applied")
    )
    return out.withColumn("status", status).drop("__top")


