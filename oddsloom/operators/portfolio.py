"""Fills and prices to positions, cash, equity, settlement and report tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsloom.functions.integers import floor_div
from oddsloom.operators.timeline import (
    MANY_ROWS,
    find_cuts,
    Timeline,
    before,
    dealt,
    latest,
    number,
    previous,
    quantiles,
    running_count,
    running_max,
    running_sum,
    scan,
    whole_first,
    whole_max,
    whole_min,
    whole_sum,
)
from oddsloom.session import settle

OPEN = 1e-12
YEAR_S = 365.25 * 24 * 3600
#: Positions of a key in one task of a rolling window.
SHARPE_ROWS = 100_000


def signed_quantity(action="action", side="side", quantity="quantity") -> Column:
    """Position change in yes contracts: buying yes or selling no adds, the reverse removes."""
    a, s, q = F.col(action), F.col(side), F.col(quantity)
    adds = ((a == "buy") & (s == "yes")) | ((a == "sell") & (s == "no"))
    cuts = ((a == "sell") & (s == "yes")) | ((a == "buy") & (s == "no"))
    return F.when(adds, q).when(cuts, -q).otherwise(0.0)


def cash_delta(action="action", price="price", quantity="quantity", commission="commission") -> Column:
    gross = F.col(price) * F.col(quantity)
    return F.when(F.col(action) == "buy", -gross).otherwise(gross) - F.coalesce(F.col(commission), F.lit(0.0))


def position_value(quantity: Column, price: Column) -> Column:
    """Long positions at the price, short ones at one minus the price, never negative."""
    value = F.when(quantity >= 0, quantity * price).otherwise(F.abs(quantity) * (1 - price))
    return F.greatest(value, F.lit(0.0))


def running_positions(fills: DataFrame, *, market: str, order: Sequence[str], width: int) -> DataFrame:
    """Signed position and cash after each fill."""
    rows = fills.withColumns({"__q": signed_quantity(), "__cash": cash_delta()})
    line = Timeline.of(market, order, width)
    return scan(
        rows, line, {"position": running_sum(F.col("__q")), "cash": running_sum(F.col("__cash"))}
    ).drop("__q", "__cash")


# ---------------------------------------------------------------- settlement

def binary_payoff(side: Column, outcome: Column) -> Column:
    """What one contract pays: the outcome, or its complement on the other side."""
    return F.when(side == "yes", outcome).otherwise(1 - outcome)


def settlement_pnl(
    fills: DataFrame, outcomes: DataFrame, *, market: str, order: Sequence[str], outcome: str = "outcome",
    payoff: Callable[[Column, Column], Column] = binary_payoff,
) -> DataFrame:
    """Profit per market with the open quantity settled at `payoff` of contract side and outcome.

    The contract side is that of the last sided fill. Markets without usable fills or
    without an outcome come back NULL or not at all, never as zero.
    """
    usable = fills.filter("quantity > 0 AND price IS NOT NULL")
    amount = F.col("price") * F.col("quantity")
    sided = F.lower(F.trim("side"))
    action = F.lower(F.trim("action"))
    sums = usable.groupBy(market).agg(
        F.sum(F.when(action == "buy", -amount).when(action == "sell", amount).otherwise(0.0)).alias("cash"),
        F.sum(
            F.when(action == "buy", F.col("quantity")).when(action == "sell", -F.col("quantity")).otherwise(0.0)
        ).alias("open_quantity"),
        F.sum(F.coalesce("commission", F.lit(0.0))).alias("commissions"),
        F.coalesce(
            F.max_by(sided, F.when(sided.isin("yes", "no"), F.struct(*order))), F.lit("yes")
        ).alias("contract_side"),
    )
    paid = payoff(F.col("contract_side"), F.col(outcome))
    return sums.join(outcomes.select(market, outcome), market, "left").withColumn(
        "settlement_pnl", F.col("cash") + paid * F.col("open_quantity") - F.col("commissions")
    )


def ledger_pnl(trades: DataFrame, outcomes: DataFrame, *, market: str, size: str, price: str) -> DataFrame:
    """Cash, open quantity, notionals and settled profit in exact decimals."""
    exact = "decimal(28,10)"
    q, p = F.col(size).cast(exact), F.col(price).cast("decimal(18,10)")
    notional = (q * p).cast("decimal(38,18)")
    buy = F.upper("side") == "BUY"
    sums = trades.groupBy(market).agg(
        F.sum(F.when(buy, -notional).otherwise(notional)).alias("cash_pnl"),
        F.sum(F.when(buy, q).otherwise(-q)).alias("open_quantity"),
        F.sum(F.when(buy, notional)).alias("buy_notional"),
        F.sum(F.when(~buy, notional)).alias("sell_notional"),
        F.count(F.lit(1)).alias("trades"),
    )
    return sums.join(outcomes, market, "left").withColumn(
        "settlement_pnl",
        F.col("cash_pnl").cast("decimal(30,10)")
        + F.col("outcome").cast("decimal(1,0)") * F.col("open_quantity").cast("decimal(28,10)"),
    )


def mark_to_market_pnl(
    fills: DataFrame, prices: DataFrame, at: DataFrame, *, market: str, order: Sequence[str], tie: Sequence[str]
) -> DataFrame:
    """Cash and marked profit per market at its time in `at(market, at_ts)`.

    The mark is the last price at or before the time, else the market's first price, else its last
    fill price.
    """
    ts = order[0]
    known = fills.join(at, market).filter((F.col(ts) <= F.col("at_ts")) & (F.col("quantity") > 0))
    money = F.col("price") * F.col("quantity")
    buy = F.col("action") == "buy"
    sums = known.groupBy(market).agg(
        F.sum(F.when(buy, -money).otherwise(money) - F.col("commission")).alias("cash_pnl"),
        F.sum(F.when(buy, F.col("quantity")).otherwise(-F.col("quantity"))).alias("open_quantity"),
        F.max_by("price", F.struct(*order)).alias("last_fill"),
    )
    stamp = F.struct(ts, *tie)
    marks = (
        prices.join(at, market)
        .groupBy(market)
        .agg(
            F.max_by("price", F.when(F.col(ts) <= F.col("at_ts"), stamp)).alias("__at"),
            F.min_by("price", stamp).alias("__first"),
        )
    )
    mark = F.coalesce("__at", "__first", "last_fill")
    out = sums.join(marks, market, "left").withColumn("mark", mark)
    return out.withColumn(
        "marked_pnl", F.col("cash_pnl") + position_value(F.col("open_quantity"), F.col("mark"))
    ).drop("__at", "__first", "last_fill")


def settlement_rule(df: DataFrame, *, observable: str, simulated_through: str, settled: str) -> DataFrame:
    """Whether settlement may replace the marked profit, and why not."""
    reason = (
        F.when(F.col(observable).isNotNull() & F.col(simulated_through).isNull(), "missing_simulated_through")
        .when(F.col(simulated_through) < F.col(observable), "resolved_after_replay")
        .when(F.col(settled).isNull(), "no_settlement")
    )
    return df.withColumn("hold_reason", reason).withColumn("settlement_applied", reason.isNull())


def adjust_series(
    series: DataFrame, adjustments: DataFrame, *, market: str, ts: str, value: str, tie: Sequence[str], width: int
) -> DataFrame:
    """Add `at_delta` at each market's `settle_ts` and `after_delta` later.

    A missing point at the settlement time is put in with the value before it (or the first value).
    The adjustment travels with the series scan, so nothing is joined on the market.
    """
    points = series.groupBy(market, ts).agg(F.max_by(value, F.struct(*tie)).alias("__v"))
    marks = adjustments.select(
        market, F.col("settle_ts").alias(ts), F.struct("settle_ts", "at_delta", "after_delta").alias("__adj")
    )
    rows = (
        points.unionByName(marks, allowMissingColumns=True)
        .groupBy(market, ts)
        .agg(F.max("__v").alias("__v"), F.max("__adj").alias("__adj"))
    )
    line = Timeline.of(market, ts, width)
    seen = scan(
        rows,
        line,
        {
            "__last": latest(F.col("__v")),
            "__first": whole_first(F.col("__v")),
            "__adj": whole_max(F.col("__adj")),
        },
    ).filter(F.col("__first").isNotNull())
    base = F.coalesce("__last", "__first")
    at = F.col("__adj.settle_ts")
    added = F.when(F.col(ts) == at, F.col("__adj.at_delta")).when(F.col(ts) > at, F.col("__adj.after_delta"))
    return seen.select(market, ts, (base + F.coalesce(added, F.lit(0.0))).alias(value))


# ---------------------------------------------------------------- equity

def _market_states(
    fills: DataFrame, prices: DataFrame, *, market: str, ts: str, order: Sequence[str], tie: Sequence[str],
    width: int, keep: Sequence[str] = (), fallback: str = "first",
) -> DataFrame:
    """Per market and instant: value before and after, cash change, and when the position ends."""
    rank = F.struct(*order)
    # Hot keys are told by the input, so that nothing of what follows runs for it.
    keys = [*keep, market]
    cuts = find_cuts(fills.select(*keys, ts).unionByName(prices.select(*keys, ts)), keys, ts, width)
    filled = fills.withColumns({"__q": signed_quantity(), "__cash": cash_delta()}).groupBy(
        *keep, market, ts
    ).agg(
        F.sum("__q").alias("__dq"),
        F.sum("__cash").alias("__dcash"),
        F.min_by("price", F.when(F.col("__q") != 0, rank)).alias("__fill_first"),
        F.max_by("price", F.when(F.col("__q") != 0, rank)).alias("__fill_last"),
    )
    quoted = prices.groupBy(*keep, market, ts).agg(F.max_by("price", F.struct(*tie)).alias("__px"))
    rows = filled.unionByName(quoted, allowMissingColumns=True).groupBy(*keep, market, ts).agg(
        F.sum("__dq").alias("__dq"),
        F.sum("__dcash").alias("__dcash"),
        F.max("__fill_first").alias("__fill_first"),
        F.max("__fill_last").alias("__fill_last"),
        F.max("__px").alias("__px"),
    )
    dq = F.coalesce(F.col("__dq"), F.lit(0.0))
    spare = whole_first(F.col("__fill_first")) if fallback == "first" else whole_max(
        F.when(F.col("__fill_last").isNotNull(), F.struct(ts, "__fill_last"))
    )
    seen = scan(
        cuts.mark(rows),
        cuts.line(keys, ts),
        {
            "position": running_sum(dq),
            "__was": before(running_sum(dq)),
            "__price": latest(F.col("__px")),
            "__price_was": before(latest(F.col("__px"))),
            "__last_quote": whole_max(F.when(F.col("__px").isNotNull(), F.col(ts))),
            "__last_fill": whole_max(F.when(F.abs(F.col("__dq")) > OPEN, F.col(ts))),
            "__spare": spare,
            "__traded": whole_max(F.col("__fill_first").isNotNull()),
        },
    )
    if fallback != "first":
        seen = seen.withColumn("__spare", F.col("__spare.__fill_last"))
    quoted_ = F.col("__last_quote").isNotNull()
    zero = F.lit(0.0)
    seen = seen.withColumns(
        {
            "__end": F.when(quoted_, F.col("__last_quote")).otherwise(F.col("__last_fill")),
            "__mark": F.when(quoted_, F.coalesce("__price", zero)).otherwise(F.col("__spare")),
            "__mark_was": F.when(quoted_, F.coalesce("__price_was", zero)).otherwise(F.col("__spare")),
        }
    )
    live = F.col("__traded") & (F.col(ts) <= F.col("__end"))
    was = F.coalesce("__was", zero)
    value = F.when(live, position_value(F.col("position"), F.col("__mark"))).otherwise(zero)
    value_was = F.when(live, position_value(was, F.col("__mark_was"))).otherwise(zero)
    is_open = F.when(live & (F.abs("position") > OPEN), 1).otherwise(0)
    was_open = F.when(live & (F.abs(was) > OPEN), 1).otherwise(0)
    return seen.select(
        *keep,
        market,
        ts,
        F.col("position"),
        value.alias("value"),
        (value - value_was).alias("d_value"),
        (is_open - was_open).alias("d_open"),
        is_open.alias("is_open"),
        F.coalesce("__dcash", zero).alias("d_cash"),
        (F.col("__traded") & (F.col(ts) == F.col("__end"))).alias("is_end"),
    )


def _with_endings(states: DataFrame, ts: str) -> DataFrame:
    """Append the step to zero one nanosecond after a position's end; not a timeline point itself."""
    change = lambda at, v, o, cash, real: F.struct(
        at.alias("at"), v.alias("d_value"), o.alias("d_open"), cash.alias("d_cash"), F.lit(real).alias("real")
    )
    steps = F.array_compact(
        F.array(
            change(F.col(ts), F.col("d_value"), F.col("d_open"), F.col("d_cash"), True),
            F.when(
                F.col("is_end"),
                change(F.col(ts) + 1, -F.col("value"), -F.col("is_open"), F.lit(0.0), False),
            ),
        )
    )
    kept = [c for c in states.columns if c not in (ts, "d_value", "d_open", "d_cash")]
    return states.withColumn("__s", F.explode(steps)).select(
        *kept, F.col("__s.at").alias(ts), "__s.d_value", "__s.d_open", "__s.d_cash", "__s.real"
    )


def equity_curve(
    fills: DataFrame,
    prices: DataFrame,
    *,
    portfolio: str,
    market: str = "market",
    order: Sequence[str],
    tie: Sequence[str],
    initial_cash: float,
    width: int,
) -> DataFrame:
    """Dense mark-to-market equity on the union of price and fill times.

    A market's value only moves at its own fills and prices and falls to zero right after its last
    price (or, without prices, its last fill), so the portfolio is the running sum of the markets'
    steps. No market is laid out on another market's timeline.
    """
    ts = order[0]
    states = _market_states(
        fills, prices, market=market, ts=ts, order=order, tie=tie, width=width, keep=[portfolio]
    )
    # One row per instant: written out, so that the scan and what follows do not replay the markets.
    steps = settle(
        _with_endings(states, ts)
        .groupBy(portfolio, ts)
        .agg(
            F.sum("d_value").alias("__v"),
            F.sum("d_cash").alias("__c"),
            F.sum("d_open").alias("__o"),
            F.max("real").alias("__real"),
        )
    )
    out = scan(
        steps,
        Timeline.of(portfolio, ts, width),
        {
            "position_value": running_sum(F.col("__v")),
            "__cash": running_sum(F.col("__c")),
            "num_positions": running_sum(F.col("__o")),
        },
    ).filter("__real")
    return out.select(
        portfolio,
        ts,
        (F.lit(float(initial_cash)) + F.col("__cash")).alias("cash"),
        "position_value",
        (F.lit(float(initial_cash)) + F.col("__cash") + F.col("position_value")).alias("equity"),
        "num_positions",
    )


def allocation_changes(
    fills: DataFrame, prices: DataFrame, *, market: str, order: Sequence[str], tie: Sequence[str],
    width: int, top: int = 50,
) -> DataFrame:
    """Value held in the `top` markets by peak value and in 'Other', at each instant it changes."""
    ts = order[0]
    states = settle(
        _market_states(fills, prices, market=market, ts=ts, order=order, tie=tie, width=width, fallback="last")
    )
    peaks = states.groupBy(market).agg(F.max("value").alias("peak"))
    ranked = (
        peaks.orderBy(F.desc("peak"), market)
        .limit(top)
        .select(market, F.col(market).cast("string").alias("__label"))
    )
    steps = (
        _with_endings(states, ts)
        .join(ranked, market, "left")
        .withColumn("label", F.coalesce("__label", F.lit("Other")))
        .groupBy("label", ts)
        .agg(F.sum("d_value").alias("__d"))
    )
    return scan(steps, Timeline.of("label", ts, width), {"value": running_sum(F.col("__d"))}).select(
        "label", ts, "value"
    )


def quantity_shares(
    fills: DataFrame, *, market: str, ts: str, order: Sequence[str], width: int, top: int = 8
) -> DataFrame:
    """Share of gross quantity in the `top` markets (ranked at the last instant) and the rest.

    Columns share_1..share_n follow the rank; one scan over the fill times carries all of them.
    """
    signed = F.when(F.col("action") == "buy", F.col("quantity")).when(
        F.col("action") == "sell", -F.col("quantity")
    ).otherwise(0.0)
    moves = fills.groupBy(market, ts).agg(F.sum(signed).alias("__d"))
    held = scan(
        moves,
        Timeline.of(market, ts, width),
        {"__q": running_sum(F.col("__d")), "__was": before(running_sum(F.col("__d")))},
    ).withColumn("__step", F.abs("__q") - F.abs(F.coalesce("__was", F.lit(0.0))))
    final = moves.groupBy(market).agg(F.abs(F.sum("__d")).alias("__final"))
    ranked = final.orderBy(F.desc("__final"), market).limit(top)
    ranked = ranked.withColumn("__rank", F.row_number().over(Window.orderBy(F.desc("__final"), market)))
    steps = held.join(ranked.select(market, "__rank"), market, "left").groupBy(ts).agg(
        *[F.sum(F.when(F.col("__rank") == i, F.col("__step")).otherwise(0.0)).alias(f"__s{i}") for i in range(1, top + 1)],
        F.sum("__step").alias("__gross"),
    )
    out = scan(
        steps.withColumn("__all", F.lit(0)),
        Timeline.of("__all", ts, width),
        {
            **{f"__r{i}": running_sum(F.col(f"__s{i}")) for i in range(1, top + 1)},
            "__total": running_sum(F.col("__gross")),
        },
    )
    share = lambda x: F.when(F.abs("__total") > OPEN, x / F.col("__total")).otherwise(0.0)
    named = [share(F.col(f"__r{i}")).alias(f"share_{i}") for i in range(1, top + 1)]
    rest = F.col("__total") - sum((F.col(f"__r{i}") for i in range(1, top + 1)), F.lit(0.0))
    return out.select(ts, *named, share(rest).alias("share_other"))


def open_positions_at(
    fills: DataFrame, snapshots: DataFrame, *, portfolio: str, market: str, order: Sequence[str], width: int
) -> DataFrame:
    """Number of markets with a position at each snapshot time."""
    from oddsloom.operators.asof import asof_backward

    ts = order[0]
    moves = fills.withColumn("__q", signed_quantity()).groupBy(portfolio, market, ts).agg(
        F.sum("__q").alias("__dq")
    )
    held = scan(
        moves,
        Timeline.of([portfolio, market], ts, width),
        {"__q": running_sum(F.col("__dq")), "__was": before(running_sum(F.col("__dq")))},
    )
    is_open = lambda c: F.when(F.abs(F.coalesce(c, F.lit(0.0))) >= OPEN, 1).otherwise(0)
    steps = held.withColumn("__o", is_open(F.col("__q")) - is_open(F.col("__was")))
    counts = scan(
        steps.groupBy(portfolio, ts).agg(F.sum("__o").alias("__o")),
        Timeline.of(portfolio, ts, width),
        {"open_positions": running_sum(F.col("__o"))},
    )
    out = asof_backward(
        snapshots, counts.select(portfolio, F.col(ts).alias("__at"), "open_positions"),
        portfolio, ts, "__at", ["open_positions"], width,
    )
    return out.withColumn("open_positions", F.coalesce("open_positions", F.lit(0))).drop("__at")


def joint_series(
    series: DataFrame, *, portfolio: str, market: str, ts: str, value: str, tie: Sequence[str], width: int
) -> DataFrame:
    """Sum over markets of the last value so far, counting nothing before a market's first point."""
    points = series.groupBy(portfolio, market, ts).agg(F.max_by(value, F.struct(*tie)).alias("__v"))
    stepped = scan(points, Timeline.of([portfolio, market], ts, width), {"__was": previous(F.col("__v"))})
    steps = stepped.withColumn("__d", F.col("__v") - F.coalesce("__was", F.lit(0.0)))
    return scan(
        steps.groupBy(portfolio, ts).agg(F.sum("__d").alias("__d")),
        Timeline.of(portfolio, ts, width),
        {value: running_sum(F.col("__d"))},
    ).drop("__d")


def drawdown(series: DataFrame, *, keys: Sequence[str], order: Sequence[str], value: str, width: int) -> DataFrame:
    """Running peak, drawdown in currency, and as a share of the peak (0 where the peak is 0)."""
    out = scan(series, Timeline.of(keys, order, width), {"peak": running_max(F.col(value))})
    gap = F.col("peak") - F.col(value)
    return out.withColumns(
        {
            "drawdown": gap,
            "drawdown_pct": F.coalesce(F.when(F.col("peak") != 0, gap / F.col("peak")), F.lit(0.0)),
        }
    )


def return_drawdown(returns: DataFrame, *, keys: Sequence[str], order: Sequence[str], ret: str, width: int) -> DataFrame:
    """Percent drawdown of the compounded returns, starting from 1.

    The product runs as a sum of logs, with total losses and sign changes counted apart.
    """
    growth = 1 + F.col(ret)
    line = Timeline.of(keys, order, width)
    out = scan(
        returns,
        line,
        {
            "__log": running_sum(F.when(growth != 0, F.log(F.abs(growth))).otherwise(0.0)),
            "__zeros": running_count(growth == 0),
            "__signs": running_count(growth < 0),
        },
        hold=True,
    )
    sign = F.when(F.col("__signs") % 2 == 1, -1.0).otherwise(1.0)
    out = out.withColumn("cumulative", F.when(F.col("__zeros") > 0, 0.0).otherwise(F.exp("__log") * sign))
    out = scan(out, line, {"__peak": running_max(F.col("cumulative"))})
    peak = F.greatest(F.lit(1.0), F.col("__peak"))
    return out.withColumn("drawdown_pct", (F.col("cumulative") - peak) / peak * 100).drop(
        "__log", "__zeros", "__signs", "__peak"
    )


def final_metrics(curve: DataFrame, *, keys: Sequence[str], order: Sequence[str], initial: float, width: int) -> DataFrame:
    """Final equity, total return and largest relative drawdown."""
    seen = drawdown(curve, keys=keys, order=order, value="equity", width=width)
    return seen.groupBy(*keys).agg(
        F.max_by("equity", F.struct(*order)).alias("final_equity"),
        F.max(F.when(F.col("peak") > 0, F.col("drawdown_pct")).otherwise(0.0)).alias("max_drawdown"),
    ).withColumn("total_return", (F.col("final_equity") - initial) / initial)


# ---------------------------------------------------------------- returns

def simple_returns(
    series: DataFrame, *, keys: Sequence[str], order: Sequence[str], value: str, width: int, hold: bool = False
) -> DataFrame:
    """Change relative to the previous point; NULL at the first point and after a zero."""
    out = scan(series, Timeline.of(keys, order, width), {"__was": previous(F.col(value))}, hold=hold)
    return out.withColumn("ret", F.when(F.col("__was") != 0, F.col(value) / F.col("__was") - 1)).drop("__was")


def return_stats(series: DataFrame, *, keys: Sequence[str], order: Sequence[str], value: str, width: int) -> DataFrame:
    """Total return, worst drawdown of compounded returns, Sharpe, Sortino and profit factor.

    Sharpe: mean / sample deviation * sqrt(252). Sortino: mean / root mean square of negative
    returns over all returns * sqrt(252). Profit factor: gains / losses.
    """
    rets = simple_returns(series, keys=keys, order=order, value=value, width=width, hold=True)
    dd = return_drawdown(
        rets.withColumn("__r", F.coalesce("ret", F.lit(0.0))), keys=keys, order=order, ret="__r", width=width
    )
    r = F.col("ret")
    rank = F.struct(*order)
    year = F.sqrt(F.lit(252.0))
    downside = F.sqrt(F.sum(F.when(r < 0, r * r).otherwise(0.0)) / F.count(r))
    gains, losses = F.sum(F.when(r > 0, r)), F.sum(F.when(r < 0, -r))
    first, last = F.min_by(value, rank), F.max_by(value, rank)
    return dd.groupBy(*keys).agg(
        F.when(F.abs(first) >= OPEN, (last / first - 1) * 100).alias("total_return_pct"),
        F.min("drawdown_pct").alias("max_drawdown_pct"),
        F.try_divide(F.avg(r), F.nullif(F.stddev_samp(r), F.lit(0.0))).alias("__sharpe"),
        F.try_divide(F.avg(r), F.nullif(downside, F.lit(0.0))).alias("__sortino"),
        F.try_divide(gains, losses).alias("profit_factor"),
    ).select(
        *keys, "total_return_pct", "max_drawdown_pct", (F.col("__sharpe") * year).alias("sharpe"),
        (F.col("__sortino") * year).alias("sortino"), "profit_factor",
    )


def compounded(returns: DataFrame, *, keys: Sequence[str], month: str, ret: str = "ret") -> DataFrame:
    """Monthly compounded returns; months inside the range without returns count as zero."""
    monthly = returns.groupBy(*keys, month).agg(F.product(1 + F.coalesce(F.col(ret), F.lit(0.0))).alias("__g"))
    # A month and those up to the next one with returns: at most one row a month, so a key's window is small.
    then = F.lead(month).over(Window.partitionBy(*keys).orderBy(month))
    gap = F.explode(F.sequence(F.col(month), F.coalesce(F.col("__then") - F.expr("interval 1 month"), F.col(month)), F.expr("interval 1 month")))
    filled = monthly.withColumn("__then", then).select(*keys, F.col(month).alias("__month"), "__g", gap.alias(month))
    g = F.when(F.col(month) == F.col("__month"), F.coalesce("__g", F.lit(1.0))).otherwise(1.0)
    return filled.select(*keys, month, (g - 1).alias("ret"))


def year_month_table(monthly: DataFrame, *, keys: Sequence[str], month: str) -> DataFrame:
    """One row per year, one column per calendar month, in percent."""
    return (
        monthly.withColumns({"year": F.year(month), "__m": F.month(month)})
        .groupBy(*keys, "year")
        .agg(*[F.max(F.when(F.col("__m") == m, F.col("ret") * 100)).alias(f"m{m:02d}") for m in range(1, 13)])
    )


def month_edges(series: DataFrame, *, keys: Sequence[str], month: Column, order: Sequence[str], value: str) -> DataFrame:
    """First and last value of each month and the return between them."""
    rank = F.struct(*order)
    out = series.groupBy(*keys, month.alias("month")).agg(
        F.min_by(value, rank).alias("first_value"), F.max_by(value, rank).alias("last_value")
    )
    return out.withColumn("ret", (F.col("last_value") - F.col("first_value")) / F.col("first_value"))


def periodic_pnl(series: DataFrame, *, key: str, order: Sequence[str], value: str, width: int) -> DataFrame:
    """Profit over 10..100 bins of (nearly) equal point counts; neighbours share an edge point."""
    line = Timeline.of(key, order, width)
    placed = scan(
        series, line, {"__pos": before(running_count()), "__n": whole_sum(F.lit(1).cast("bigint"))}
    ).filter("__n >= 4")
    counts = placed.groupBy(key).agg(F.max("__n").alias("n"))
    bins = F.greatest(F.lit(10), F.least(F.lit(100), F.floor(F.col("n") / 20)))
    edges = counts.withColumn("bins", bins).select(key, "n", "bins", F.explode(F.sequence(F.lit(0).cast("bigint"), "bins")).alias("i"))
    step = (F.col("n") - 1) / F.col("bins")
    edges = edges.withColumn(
        "__pos", F.when(F.col("i") == F.col("bins"), F.col("n") - 1).otherwise(F.floor(F.col("i") * step))
    )
    at = edges.join(placed.select(key, "__pos", F.col(value).alias("v"), F.col(order[0]).alias("t")), [key, "__pos"])
    # At most 101 edges per key.
    w = Window.partitionBy(key).orderBy("i")
    return at.select(
        key,
        (F.col("i") - 1).alias("bin"),
        F.lag("t").over(w).alias("start_ts"),
        F.col("t").alias("end_ts"),
        (F.col("v") - F.lag("v").over(w)).alias("pnl"),
    ).filter("bin >= 0")


def histogram(df: DataFrame, *, key: str, order: Sequence[str], value: str, bins: int, width: int) -> DataFrame:
    """Counts over `bins` equal slices between a key's smallest and largest value."""
    spread = scan(
        df.filter(F.col(value).isNotNull()),
        Timeline.of(key, order, width),
        {"__lo": whole_min(F.col(value)), "__hi": whole_max(F.col(value))},
    )
    size = (F.col("__hi") - F.col("__lo")) / bins
    slot = F.when(size > 0, F.least(F.floor((F.col(value) - F.col("__lo")) / size), F.lit(bins - 1))).otherwise(0)
    return spread.groupBy(key, slot.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("__lo") + slot * size).alias("lower")
    )


def rolling_sharpe(
    series: DataFrame, *, key: str, order: Sequence[str], value: str, width: int, median_width: float,
    ts_per_second: float = 1e9,
) -> DataFrame:
    """Rolling Sharpe over clamp(n/20, 20, 500) returns, annualised by the median spacing.

    Positions are cut into blocks of one window length; a window is the end of one block and the
    start of the next, so its sums hold its own returns only. Tasks take some 100,000 positions
    each and the block before them, however many rows a key has.
    """
    ts = order[0]
    line = Timeline.of(key, order, width)
    base = scan(
        series, line,
        {
            "__was": previous(F.struct(F.col(value).alias("v"), F.col(ts).alias("t"))), "__pos": before(running_count()),
            "__n": whole_sum(F.lit(1).cast("bigint")),
        },
    )
    base = settle(base.select(
        key, *order, "__pos", "__n", F.when(F.col("__was.v") != 0, F.col(value) / F.col("__was.v") - 1).alias("__r"),
        (F.col(ts) - F.col("__was.t")).cast("double").alias("__gap"),
    ))
    w = F.col("window")
    placed = base.filter("__n >= 60").withColumn(
        "window", F.greatest(F.lit(20), F.least(F.lit(500), F.floor(F.col("__n") / 20))).cast("bigint")
    )
    placed = placed.withColumn("__size", w * F.ceil(F.lit(SHARPE_ROWS) / w))
    placed = placed.withColumn("__home", floor_div("__pos", F.col("__size")))
    lent = F.col("__pos") % F.col("__size") >= F.col("__size") - w
    both = F.when(lent, F.array("__home", F.col("__home") + 1)).otherwise(F.array("__home"))
    spread = placed.withColumn("__task", F.explode(both))
    rows = base.count()
    spread = dealt(spread, rows, key, "__task") if rows > MANY_ROWS else spread.repartition(key, "__task")
    spread = spread.withColumns({"__block": floor_div("__pos", w), "__slot": F.col("__pos") % w})
    inside = Window.partitionBy(key, "__task", "__block").orderBy("__pos")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = inside.rowsBetween(1, Window.unboundedFollowing)
    r = F.coalesce("__r", F.lit(0.0))
    terms = {"s": r, "q": r * r, "bad": F.when(F.col("__r").isNull(), 1.0).otherwise(0.0)}
    parts = {f"__{x}_{n}": F.coalesce(F.sum(c).over(f), F.lit(0.0)) for n, c in terms.items() for x, f in (("upto", upto), ("later", later))}
    spread = spread.withColumns(parts)
    # The rest of the window: the block before, from the slot after this row's on.
    same_slot = Window.partitionBy(key, "__task", "__slot").orderBy("__block")
    rest = F.lag(F.struct(*[F.col(f"__later_{n}").alias(n) for n in terms])).over(same_slot)
    met = spread.withColumn("__rest", rest).filter("__task = __home")
    # A window that ends its block lies in it alone; the first ones have no block before them.
    ready = F.col("__pos") >= w
    total = {n: F.col(f"__upto_{n}") + F.coalesce(F.col(f"__rest.{n}"), F.lit(0.0)) for n in terms}
    mean = total["s"] / w
    var = (total["q"] - w * mean * mean) / (w - 1)
    full = ready & (total["bad"] == 0)
    spacing = quantiles(base, [key], "__gap", {"__median": 0.5}, median_width)
    year = F.greatest(F.lit(1.0), F.lit(YEAR_S) / (F.col("__median") / F.lit(ts_per_second)))
    return met.join(spacing, key, "left").select(
        key, *order, "window", F.when(full & (var > 1e-18), mean / F.sqrt(var) * F.sqrt(year)).alias("sharpe")
    )


def place_fills(fills: DataFrame, curve: DataFrame, *, key: str, ts: str, width: int) -> DataFrame:
    """Bar index of each fill: the last equity point at or before it, at least 0."""
    from oddsloom.operators.asof import asof_backward

    bars = number(curve.select(key, F.col(ts).alias("__bar_ts")), Timeline.of(key, "__bar_ts", width), "bar")
    out = asof_backward(fills, bars, key, ts, "__bar_ts", ["bar"], width)
    return out.withColumn("bar", F.coalesce("bar", F.lit(0))).drop("__bar_ts")


def merged_prices(primary: DataFrame, secondary: DataFrame, *, market: str, ts: str, tie: Sequence[str]) -> DataFrame:
    """Two price sources on one series; at one instant the secondary source wins, then the last row."""
    both = primary.withColumn("__src", F.lit(0)).unionByName(secondary.withColumn("__src", F.lit(1)))
    return both.groupBy(market, ts).agg(F.max_by("price", F.struct("__src", *tie)).alias("price"))


def fill_stats(fills: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """Quantity, notional and average price of usable fills, with a total over all groups."""
    usable = fills.filter("quantity > 0 AND price >= 0")
    qty, notional = F.sum("quantity"), F.sum(F.col("quantity") * F.col("price"))
    return usable.rollup(*by).agg(
        F.count(F.lit(1)).alias("fills"),
        qty.alias("quantity"),
        notional.alias("notional"),
        F.try_divide(notional, qty).alias("average_price"),
    )
