"""Price edge of a forecast against quoted tokens, entry selection and entry metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.functions.integers import floor_div
from oddsloom.operators.asof import asof_backward
from oddsloom.operators.timeline import Timeline, latest, previous, running_count, scan
from oddsloom.session import DAY_NS

# Entry price cap, regime bounds in elapsed units, and the threshold ladder.
MAX_ENTRY_PRICE = 0.999999
REGIMES = (
    ("early_3s_to_30s", 3.0, 30.0),
    ("price_discovery_35s_to_90s", 30.0, 90.0),
    ("mid_early_95s_to_180s", 90.0, 180.0),
)


def regime(elapsed: Column) -> Column:
    """Named slice of the first 180 elapsed units; NULL outside 3..180."""
    (first, lo, hi), *rest = REGIMES
    out = F.when((elapsed >= lo) & (elapsed <= hi), first)
    for name, low, high in rest:
        out = out.when((elapsed > low) & (elapsed <= high), name)
    return out


def dual_token_prices(
    decisions: DataFrame,
    prices: DataFrame,
    *,
    up: str,
    down: str,
    decision_ts: str,
    market_start: str,
    token: str,
    price_ts: str,
    price: str,
    tie: Sequence[str],
    max_age: int,
    width: int | None,
) -> DataFrame:
    """Latest up and down price known at each decision, both no older than `max_age` and not from
    before the market's start; decisions lacking either are dropped.

    A decision asks for its two tokens with two probes of one as-of scan, so prices are shuffled
    once; the probes meet again by the decision's own columns, which must identify it.
    """
    own = decisions.columns
    probes = decisions.withColumn(
        "__leg", F.explode(F.array(F.struct(F.lit("up").alias("leg"), F.col(up).alias("token")),
                                   F.struct(F.lit("down").alias("leg"), F.col(down).alias("token"))))
    ).select(*own, F.col("__leg.leg").alias("__which"), F.col("__leg.token").alias("__token"))
    quoted = prices.select(
        F.col(token).alias("__token"), F.col(price_ts).alias("__at"), F.col(price).alias("__price"), *tie
    )
    hits = asof_backward(
        probes, quoted, "__token", decision_ts, "__at", ["__price"], width, right_tie=tie
    ).filter(F.col("__at") >= F.col(market_start))
    leg = lambda which, column: F.max(F.when(F.col("__which") == which, F.col(column)))
    both = hits.groupBy(*own).agg(
        leg("up", "__at").alias("up_ts"),
        leg("up", "__price").alias("up_price"),
        leg("down", "__at").alias("down_ts"),
        leg("down", "__price").alias("down_price"),
    )
    return (
        both.filter("up_ts IS NOT NULL AND down_ts IS NOT NULL")
        .withColumn("price_age_ns", F.col(decision_ts) - F.least("up_ts", "down_ts"))
        .filter(F.col("price_age_ns") <= max_age)
    )


def edge_candidates(quoted: DataFrame, *, p_up: str, label: str, buffer: float) -> DataFrame:
    """Side with the larger edge, its capped entry price, edge and settled profit per share."""
    cap = F.lit(MAX_ENTRY_PRICE)
    up_entry = F.least(cap, F.col("up_price") + F.lit(buffer))
    down_entry = F.least(cap, F.col("down_price") + F.lit(buffer))
    up_edge = F.col(p_up) - up_entry
    down_edge = F.lit(1.0) - F.col(p_up) - down_entry
    is_up = up_edge >= down_edge
    pick = lambda a, b: F.when(is_up, a).otherwise(b)
    return (
        quoted.withColumns(
            {
                "side": pick(F.lit("up"), F.lit("down")),
                "p_side": pick(F.col(p_up), F.lit(1.0) - F.col(p_up)),
                "observed_token_price": pick(F.col("up_price"), F.col("down_price")),
                "entry_price": pick(up_entry, down_entry),
                "predicted_edge": pick(up_edge, down_edge),
                "outcome": pick(F.col(label), F.lit(1) - F.col(label)),
            }
        ).withColumn("pnl_per_share", F.col("outcome") - F.col("entry_price"))
    )


def first_persistent_entry(
    candidates: DataFrame,
    *,
    market: str | Sequence[str],
    ts: str,
    side: str,
    passes: Column,
    signals: int,
    max_gap: int,
    width: int | None,
    drop_failing_first: bool = False,
) -> DataFrame:
    """Earliest candidate per market that completes `signals` same-side signals in a row.

    A run grows while the side repeats and the step in time is within (0, max_gap]. A failing row
    ends the run, unless `drop_failing_first` removes failing rows before runs are counted.
    """
    keys = [market] if isinstance(market, str) else list(market)
    columns = candidates.columns
    rows = candidates.withColumn("__ok", F.coalesce(passes, F.lit(False)))
    if drop_failing_first:
        rows = rows.filter("__ok")
    line = Timeline.of(keys, [ts, side], width)
    if signals > 1:
        seen = scan(
            rows,
            line,
            {
                "__prev": previous(F.struct(F.col(side).alias("s"), F.col(ts).alias("t"), "__ok")),
                "__pos": running_count(),
            },
            hold=signals > 2,
        )
        step = F.col(ts) - F.col("__prev.t")
        linked = F.coalesce(
            F.col("__ok")
            & F.col("__prev.__ok")
            & (F.col("__prev.s") == F.col(side))
            & (step > 0)
            & (step <= max_gap),
            F.lit(False),
        )
        if signals == 2:
            rows = seen.filter(linked)
        else:
            seen = seen.withColumn("__break", F.when(~linked, F.col("__pos")))
            seen = scan(seen, line, {"__start": latest(F.col("__break"))})
            rows = seen.filter(F.col("__pos") - F.col("__start") + 1 >= signals)
    return (
        rows.filter("__ok")
        .groupBy(*keys)
        .agg(F.min_by(F.struct(*columns), F.struct(ts, side)).alias("__row"))
        .select("__row.*")
    )


def entry_metrics(entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count, hit rate, average price and edge, value per share and profit factor of entries."""
    pnl = F.col("pnl_per_share")
    gain = F.sum(F.when(pnl > 0, pnl).otherwise(0.0))
    loss = F.sum(F.when(pnl < 0, -pnl).otherwise(0.0))
    return entries.groupBy(*by).agg(
        F.count(F.lit(1)).alias("entry_count"),
        F.avg("outcome").alias("win_rate"),
        F.avg("entry_price").alias("average_entry_price"),
        F.avg("predicted_edge").alias("average_predicted_edge"),
        F.avg(pnl).alias("realized_ev_per_share"),
        F.when(loss > 0, gain / loss).alias("profit_factor"),
    )


def sensitivity(candidates: DataFrame, scenarios: Sequence[Mapping[str, float]]) -> DataFrame:
    """Candidates repriced under each (scenario, extra_cost, max_age); a literal table of scenarios."""
    table = F.array(
        *[
            F.struct(
                F.lit(s["scenario"]).alias("scenario"),
                F.lit(float(s["extra_cost"])).alias("extra_cost"),
                F.lit(int(s["max_age"])).alias("max_age"),
            )
            for s in scenarios
        ]
    )
    return (
        candidates.withColumn("__s", F.explode(table))
        .select("*", "__s.*")
        .drop("__s")
        .filter(F.col("price_age_ns") <= F.col("max_age"))
        .withColumn(
            "entry_price", F.least(F.lit(MAX_ENTRY_PRICE), F.col("entry_price") + F.col("extra_cost"))
        )
        .withColumn("predicted_edge", F.col("predicted_edge") - F.col("extra_cost"))
        .withColumn("pnl_per_share", F.col("outcome") - F.col("entry_price"))
    )


def utc_day(ts_ns: str) -> Column:
    return floor_div(ts_ns, DAY_NS)
