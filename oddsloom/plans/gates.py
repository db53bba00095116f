"""Gates, payload scans, two-book checks and custom settlement on the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsloom.operators import evaluate as ev
from oddsloom.operators import features as ft
from oddsloom.operators import markets as mk
from oddsloom.operators import portfolio as pf
from oddsloom.plans.analogs import TICKS, Tables
from oddsloom.plans.portfolio import BOOKS, ORDER, SQL_ORDER, outcomes, rounded, trades
from oddsloom.plans.registry import query
from oddsloom.sources import store

MINUTE = 60_000_000_000


@query(
    "direction_gate",
    "A36",
    f"""WITH {TICKS},
    e AS (SELECT user_id, count(*) * 400 AS n, avg(price) - 0.48 AS ll, avg(size) / 100 - 0.2 AS br, max(price) * 1.3 AS slope FROM ticks GROUP BY 1),
    b AS (SELECT floor(price * 5) AS band, count(*) AS n, abs(avg(price) - 0.1 - floor(price * 5) / 5) AS err FROM ticks GROUP BY 1),
    w AS (SELECT max(CASE WHEN n < 300 THEN 1 ELSE 0 END) = 1 AS few, max(CASE WHEN err > 0.03 THEN 1 ELSE 0 END) = 1 AS off FROM b)
    SELECT user_id, concat_ws(',', CASE WHEN n < 2500 THEN 'insufficient_sealed_holdout_markets' END, CASE WHEN ll < 0.002 THEN 'log_loss_improvement_below_threshold' END,
             CASE WHEN ll - 0.01 <= 0 THEN 'log_loss_ci_lower_not_positive' END, CASE WHEN br < 0.001 THEN 'brier_improvement_below_threshold' END,
             CASE WHEN br - 0.02 <= 0 THEN 'brier_ci_lower_not_positive' END, CASE WHEN NOT slope BETWEEN 0.8 AND 1.2 THEN 'calibration_slope_out_of_range' END,
             CASE WHEN few THEN 'target_bin_insufficient_samples' END, CASE WHEN off THEN 'target_bin_calibration_error_exceeds_limit' END) AS failed_conditions
    FROM e, w""",
)
def _direction(t: Tables):
    better, brier = F.avg("price") - 0.48, F.avg("size") / 100 - 0.2
    evidence = t.ticks.groupBy("user_id").agg(
        (F.count(F.lit(1)) * 400).alias("sealed_holdout_markets"), better.alias("log_loss_improvement"), (better - 0.01).alias("log_loss_ci_lower"),
        brier.alias("brier_improvement"), (brier - 0.02).alias("brier_ci_lower"), (F.max("price") * 1.3).alias("calibration_slope"),
    )
    band = F.floor(F.col("price") * 5)
    bands = t.ticks.groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("effective_market_count"), F.abs(F.avg("price") - 0.1 - F.first(band) / 5).alias("calibration_error")
    )
    return ev.direction_gate(evidence, bands).select("user_id", F.concat_ws(",", "failed_conditions").alias("failed_conditions"))


@query(
    "mispricing_gate",
    "A36",
    f"""WITH {TICKS} SELECT user_id, CASE WHEN avg(price) - 0.5 <= 0 THEN 'paired_net_edge_ci_lower_must_be_positive' ELSE '' END AS failed_conditions,
    avg(price) - 0.5 > 0 AS accepted FROM ticks GROUP BY 1""",
)
def _mispricing(t: Tables):
    evidence = t.ticks.groupBy("user_id").agg((F.avg("price") - 0.5).alias("paired_net_edge_ci_lower"))
    return ev.mispricing_gate(evidence).select("user_id", F.concat_ws(",", "failed_conditions").alias("failed_conditions"), "accepted")


def payloads(t: Tables):
    kind = F.when(F.col("event_type") == "view", "book_snapshot").when(F.col("event_type") == "signup", "tick_size_change").otherwise("price_change")
    return t.ticks.select(
        "event_id", F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("market_id"), kind.alias("update_type"),
        F.to_json(F.struct(F.col("user_id").cast("string").alias("token_id"), F.col("price").cast("string").alias("change_price"))).alias("data"),
    )


@query(
    "payload_scan",
    "S2",
    f"""WITH {TICKS}, r AS (SELECT event_id, user_id FROM ticks WHERE user_id % 3 = 1 AND event_type <> 'signup')
    SELECT event_id, 'market' AS request FROM r UNION ALL SELECT event_id, 'token' FROM r WHERE user_id = 4""",
)
def _payload_scan(t: Tables):
    rows = payloads(t)
    one = lambda df, name: df.select("event_id", F.lit(name).alias("request"))
    return one(store.scan_payload(rows, market="m1"), "market").union(one(store.scan_payload(rows, market="m1", token="4"), "token"))


@query(
    "dual_book_quality",
    "F5",
    f"""WITH {TICKS},
    b AS (SELECT event_id, ts_ns, CASE WHEN event_type <> 'error' THEN price - 0.01 END AS ub, CASE WHEN event_type <> 'error' THEN price + 0.01 END AS ua,
                 CASE WHEN size % 11 > 0 THEN 0.99 - price + event_id % 5 / 80 END AS db, CASE WHEN size % 11 > 0 THEN 1.01 - price + event_id % 5 / 80 END AS da,
                 ts_ns - size * {MINUTE} AS u_at, ts_ns - event_id % 40 * {MINUTE} AS d_at FROM ticks)
    SELECT event_id, ub IS NULL OR db IS NULL AS book_unavailable,
           round(CASE WHEN ub IS NULL OR db IS NULL THEN 0.5 ELSE greatest(1e-6, least(1 - 1e-6, ((ub + ua) / 2 + 1 - (db + da) / 2) / 2)) END, 9) AS p_market_mid_up,
           coalesce(ub IS NOT NULL AND db IS NOT NULL AND (ts_ns - u_at > {30 * MINUTE} OR ts_ns - d_at > {30 * MINUTE}), false) AS book_stale,
           coalesce(ub IS NOT NULL AND db IS NOT NULL AND event_id % 5 / 80 > 0.02, false) AS complement_mismatch
    FROM b""",
)
def _dual_quality(t: Tables):
    price, off = F.col("price"), F.col("event_id") % 5 / 80
    up, down = F.col("event_type") != "error", F.col("size") % 11 > 0
    books = t.ticks.select(
        "event_id", "ts_ns", F.when(up, price - 0.01).alias("up_bid"), F.when(up, price + 0.01).alias("up_ask"),
        F.when(down, 0.99 - price + off).alias("down_bid"), F.when(down, 1.01 - price + off).alias("down_ask"),
        (F.col("ts_ns") - F.col("size") * MINUTE).alias("up_at"), (F.col("ts_ns") - F.col("event_id") % 40 * MINUTE).alias("down_at"),
    )
    out = books.select("event_id", *[c.alias(n) for n, c in ft.dual_book_probability(now="ts_ns", stale_ns=30 * MINUTE).items()])
    return out.withColumn("p_market_mid_up", F.round("p_market_mid_up", 9))


@query(
    "void_settlement",
    "E2 A9",
    f"""WITH {BOOKS},
    sums AS (
      SELECT market, sum(CASE WHEN action = 'buy' THEN -price * quantity ELSE price * quantity END) AS cash,
             sum(CASE WHEN action = 'buy' THEN quantity ELSE -quantity END) AS open_quantity, sum(commission) AS commissions,
             arg_max(side, ({SQL_ORDER})) AS contract_side
      FROM trades GROUP BY 1)
    SELECT s.market, round(cash + CASE WHEN outcome IS NULL THEN 0.5 WHEN contract_side = 'yes' THEN outcome ELSE 1 - outcome END * open_quantity - commissions, 6) AS settlement_pnl
    FROM sums s LEFT JOIN outcomes o ON s.market = o.market""",
)
def _void(t: Tables):
    """A market without an outcome is void and pays half."""
    half = lambda side, outcome: F.coalesce(pf.binary_payoff(side, outcome), F.lit(0.5))
    out = pf.settlement_pnl(trades(t), outcomes(t), market="market", order=ORDER, payoff=half)
    return rounded(out.select("market", "settlement_pnl"), 6)


@query(
    "window_ids",
    "X11 X12",
    f"""WITH {TICKS} SELECT event_id, ts_ns // 1000000000 // 300 * 300 AS window_start_s,
    sha256(concat_ws('|', CAST(user_id AS VARCHAR), event_type, CAST(ts_ns // 1000000000 // 300 * 300 AS VARCHAR))) AS content_id FROM ticks""",
)
def _window_ids(t: Tables):
    start = mk.five_minute_floor((F.col("ts_ns") / 1_000_000_000).cast("bigint"))
    return t.ticks.select("event_id", start.alias("window_start_s"), mk.content_id(F.col("user_id"), F.col("event_type"), start).alias("content_id"))
