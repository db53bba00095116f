"""Forecast scores, calibration, bootstraps, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsloom.operators import evaluate as ev
from oddsloom.operators.edge import entry_metrics, first_persistent_entry, sensitivity
from oddsloom.plans.analogs import DAY_NS, FORECASTS, TICK_CHUNK, Tables
from oddsloom.plans.edge_study import (
    CANDIDATES,
    HOUR,
    METRICS,
    candidates,
    persistent_sql,
    rounded,
)
from oddsloom.plans.registry import query
from oddsloom.session import beside, settle

LL = "-(outcome * ln(least(1 - 1e-6, greatest(1e-6, p_up))) + (1 - outcome) * ln(1 - least(1 - 1e-6, greatest(1e-6, p_up))))"
BIN = "CASE WHEN p_up < 0.1 THEN 0 WHEN p_up < 0.2 THEN 1 WHEN p_up < 0.3 THEN 2 WHEN p_up < 0.4 THEN 3 WHEN p_up < 0.5 THEN 4 WHEN p_up < 0.6 THEN 5 WHEN p_up < 0.7 THEN 6 WHEN p_up < 0.8 THEN 7 WHEN p_up < 0.9 THEN 8 ELSE 9 END"


@query(
    "probability_scores",
    "A1 A6 X10",
    f"""WITH {FORECASTS},
    b AS (SELECT *, {BIN} AS bin, {LL} AS ll FROM forecasts),
    e AS (
      SELECT regime, count(*) AS count, round(avg((p_up - outcome) ** 2), 9) AS brier_score, round(avg(ll), 9) AS log_loss FROM b GROUP BY GROUPING SETS ((), (regime))),
    bins AS (SELECT regime, bin, grouping(regime) AS g, sum(p_up) AS p, sum(outcome) AS y, count(*) AS n FROM b GROUP BY GROUPING SETS ((bin), (regime, bin))),
    c AS (SELECT regime, g, sum(abs(p - y)) / sum(n) AS ece FROM bins GROUP BY 1, 2)
    SELECT e.regime, e.count, e.brier_score, e.log_loss, round(c.ece, 9) AS calibration_error
    FROM e JOIN c ON e.regime IS NOT DISTINCT FROM c.regime""",
)
def _scores(t: Tables):
    return rounded(ev.probability_scores(t.forecasts, p="p_up", y="outcome", groups=[(), ("regime",)]))


@query(
    "calibration_bins",
    "A2",
    f"""WITH {FORECASTS},
    edges AS (SELECT * FROM (VALUES (0, 0.0, 0.05), (1, 0.05, 0.25), (2, 0.25, 0.5), (3, 0.5, 0.51), (4, 0.51, 0.9), (5, 0.9, 1.0)) AS v(bin, lower, upper)),
    s AS (SELECT e.bin, count(f.p_up) AS n, avg(f.p_up) AS mp, avg(f.outcome) AS my FROM edges e
          LEFT JOIN forecasts f ON f.p_up >= e.lower AND (f.p_up < e.upper OR (e.bin = 5 AND f.p_up <= e.upper)) GROUP BY 1)
    SELECT e.bin, CAST(e.lower AS DOUBLE) AS lower, CAST(e.upper AS DOUBLE) AS upper, n AS count, round(mp, 9) AS mean_probability,
           round(my, 9) AS observed_rate, round(abs(mp - my), 9) AS absolute_error
    FROM edges e JOIN s ON e.bin = s.bin""",
)
def _bins(t: Tables):
    return rounded(ev.calibration_bins(t.forecasts, p="p_up", y="outcome", edges=(0.0, 0.05, 0.25, 0.5, 0.51, 0.9, 1.0)))


def newton_sql(weight: str, ridge: float) -> str:
    return f"""WITH RECURSIVE {FORECASTS},
    g AS (SELECT ln(q / (1 - q)) AS x, sum(w) AS w, sum(w * outcome) AS wy
          FROM (SELECT least(1 - 1e-6, greatest(1e-6, p_up)) AS q, {weight} AS w, outcome FROM forecasts) GROUP BY 1),
    it(i, a, b) AS (
      SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)
      UNION ALL
      SELECT i + 1, a + ((h11 + {ridge}) * g0 - h01 * (g1 - {ridge} * b)) / (h00 * (h11 + {ridge}) - h01 * h01),
             b + (h00 * (g1 - {ridge} * b) - h01 * g0) / (h00 * (h11 + {ridge}) - h01 * h01)
      FROM (SELECT i, a, b, sum(wy - w * mu) AS g0, sum((wy - w * mu) * x) AS g1, sum(w * mu * (1 - mu)) AS h00,
                   sum(w * mu * (1 - mu) * x) AS h01, sum(w * mu * (1 - mu) * x * x) AS h11
            FROM (SELECT i, a, b, w, wy, x, 1 / (1 + exp(-(a + b * x))) AS mu FROM it, g WHERE i < 15) GROUP BY i, a, b))
    SELECT round(a, 6) AS intercept, round(b, 6) AS slope FROM it WHERE i = 15"""


@query("calibration_line", "A3", newton_sql("1.0", 0.0))
def _line(t: Tables):
    return rounded(ev.calibration_line(t.forecasts, p="p_up", y="outcome"), 6)


@query("weighted_calibration_slope", "A4", newton_sql("weight", 1e-6))
def _wline(t: Tables):
    return rounded(ev.calibration_line(t.forecasts, p="p_up", y="outcome", weight="weight", ridge=1e-6), 6)


@query(
    "weighted_calibration_error",
    "A4 A6",
    f"""WITH {FORECASTS},
    edges AS (SELECT CAST(i AS DOUBLE) * CAST(0.1 AS DOUBLE) AS lo, CAST(i AS DOUBLE) * CAST(0.1 AS DOUBLE) + CAST(0.1 AS DOUBLE) AS hi FROM (SELECT unnest(range(0, 10)) AS i)),
    bins AS (
      SELECT regime, lo, sum(weight * p_up) AS p, sum(weight * outcome) AS y
      FROM forecasts JOIN edges ON p_up >= lo AND (p_up < hi OR (hi >= 1 AND p_up <= hi)) GROUP BY 1, 2),
    tot AS (SELECT regime, sum(weight) AS w FROM forecasts GROUP BY 1)
    SELECT b.regime, round(sum(abs(y - p)) / max(w), 9) AS weighted_calibration_error FROM bins b JOIN tot USING (regime) GROUP BY 1""",
)
def _wece(t: Tables):
    return rounded(ev.weighted_calibration_error(t.forecasts, p="p_up", y="outcome", weight="weight", by=["regime"]))


@query(
    "confidence_bands",
    "A5",
    f"""WITH {FORECASTS},
    c AS (SELECT *, greatest(p_up, 1 - p_up) AS conf, CASE WHEN (p_up >= 0.5) = (outcome = 1) THEN 1.0 ELSE 0.0 END AS ok FROM forecasts),
    dim AS (SELECT * FROM (VALUES (0, 0.55, 0.60), (1, 0.60, 0.65), (2, 0.65, 0.70), (3, 0.70, 1.00)) AS v(band, lower, upper)),
    s AS (SELECT d.band, count(c.conf) AS n, count(DISTINCT c.market) AS m, sum(weight * conf) / sum(weight) AS mc, sum(weight * ok) / sum(weight) AS acc
          FROM dim d LEFT JOIN c ON conf >= CAST(lower AS DOUBLE) AND (conf < CAST(upper AS DOUBLE) OR (band = 3 AND conf <= 1)) GROUP BY 1)
    SELECT d.band, CAST(lower AS DOUBLE) AS lower, CAST(upper AS DOUBLE) AS upper, n AS snapshot_count, m AS effective_market_count,
           round(mc, 9) AS mean_confidence, round(acc, 9) AS observed_accuracy, round(coalesce(abs(acc - mc), 1), 9) AS calibration_error
    FROM dim d JOIN s ON d.band = s.band""",
)
def _bands(t: Tables):
    return rounded(ev.confidence_bands(t.forecasts, p="p_up", y="outcome", weight="weight", market="market"))


MAKER = """maker AS (
  SELECT l_partkey AS market, CASE WHEN l_linestatus = 'O' THEN 'up' ELSE 'down' END AS side, epoch_us(l_shipdate) * 1000 AS ts_ns,
         0.5 + l_tax AS p_boundary, 0.45 + l_discount * 2 AS p_fair, 0.5 + l_discount AS p_market, 0.4 + l_tax * 2 AS entry_price,
         l_quantity AS shares, round(l_quantity * 0.001, 3) AS fee, CAST(CASE WHEN l_linenumber = 1 THEN 0.002 ELSE 0.0 END AS DOUBLE) AS rebate,
         CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS outcome
  FROM lineitem)"""


def maker(t: Tables):
    from oddsloom.plans.analogs import nanos

    return t.read("lineitem").select(
        F.col("l_partkey").alias("market"),
        F.when(F.col("l_linestatus") == "O", "up").otherwise("down").alias("side"),
        nanos("l_shipdate").alias("ts_ns"),
        (0.5 + F.col("l_tax")).alias("p_boundary"),
        (0.45 + F.col("l_discount") * 2).alias("p_fair"),
        (0.5 + F.col("l_discount")).alias("p_market"),
        (0.4 + F.col("l_tax") * 2).alias("entry_price"),
        F.col("l_quantity").alias("shares"),
        F.round(F.col("l_quantity") * 0.001, 3).alias("fee"),
        F.when(F.col("l_linenumber") == 1, 0.002).otherwise(0.0).alias("rebate"),
        F.when(F.col("l_returnflag") == "N", 1).otherwise(0).alias("outcome"),
    )


@query(
    "maker_fill_summary",
    "A7",
    f"""WITH {MAKER},
    n AS (SELECT *, shares * (p_fair - entry_price) - fee + rebate AS net, shares * (outcome - entry_price) - fee + rebate AS real FROM maker)
    SELECT side, count(*) AS count, sum(shares) AS total_shares, round(sum(net), 5) AS net_expected_value, round(sum(real), 5) AS realized_pnl,
           round(sum(fee), 5) AS total_fee, round(sum(rebate), 5) AS total_rebate, round(sum(net) / sum(shares), 9) AS net_expected_value_per_share,
           round(sum(real) / sum(shares), 9) AS realized_pnl_per_share
    FROM n GROUP BY 1""",
)
def _maker(t: Tables):
    out = ev.maker_fill_summary(maker(t), by=["side"])
    five = ["net_expected_value", "realized_pnl", "total_fee", "total_rebate"]
    nine = ["net_expected_value_per_share", "realized_pnl_per_share"]
    return out.withColumns({**{c: F.round(c, 5) for c in five}, **{c: F.round(c, 9) for c in nine}})


@query(
    "edge_attribution",
    "A8",
    f"""WITH {MAKER}
    SELECT market, round(avg(p_boundary - 0.5), 9) AS boundary_probability_edge, round(avg(p_fair - p_boundary), 9) AS opening_information_edge,
           round(avg(0.5 - entry_price), 9) AS maker_discount, round(avg(p_fair - p_market), 9) AS market_mispricing_edge
    FROM maker GROUP BY 1""",
)
def _attribution(t: Tables):
    parts = ev.edge_attribution(p_boundary="p_boundary", p_fair="p_fair", p_market="p_market", price="entry_price")
    return rounded(maker(t).withColumns(parts).groupBy("market").agg(*[F.avg(c).alias(c) for c in parts]))


CONCENTRATION = f"""{MAKER},
n AS (SELECT side, ts_ns, round(shares * (outcome - entry_price) - fee + rebate, 6) AS pnl FROM maker),
weeks AS (SELECT side, ts_ns // {7 * DAY_NS} AS w, sum(pnl) AS p FROM n GROUP BY 1, 2),
months AS (SELECT side, date_trunc('month', make_timestamp(ts_ns // 1000)) AS m, sum(pnl) AS p FROM n GROUP BY 1, 2),
cut AS (SELECT side, quantile_cont(pnl, 0.99) AS q FROM n GROUP BY 1),
kept AS (SELECT n.side, sum(pnl) AS p FROM n JOIN cut ON n.side = cut.side WHERE pnl <= q GROUP BY 1),
ws AS (SELECT side, avg(CASE WHEN p > 0 THEN 1.0 ELSE 0.0 END) AS ratio FROM weeks GROUP BY 1),
ms AS (SELECT side, max(p) AS top, sum(p) AS total FROM months GROUP BY 1),
conc AS (
  SELECT ms.side, round(total, 5) AS total_pnl, round(ratio, 9) AS positive_week_ratio, round(kept.p, 5) AS pnl_without_top_one_percent,
         round(CASE WHEN total > 0 THEN least(1, greatest(0, top / total)) ELSE 1 END, 9) AS largest_month_pnl_share
  FROM ms JOIN ws USING (side) JOIN kept USING (side))"""


def concentration(t: Tables):
    rows = maker(t).withColumn(
        "pnl",
        F.round(F.col("shares") * (F.col("outcome") - F.col("entry_price")) - F.col("fee") + F.col("rebate"), 6),
    )
    return ev.pnl_concentration(rows, pnl="pnl", ts="ts_ns", by=["side"], width=5.0)


@query("pnl_concentration", "A37", f"WITH {CONCENTRATION} SELECT * FROM conc")
def _concentration(t: Tables):
    out = concentration(t)
    return out.select(
        "side", F.round("total_pnl", 5).alias("total_pnl"), F.round("positive_week_ratio", 9).alias("positive_week_ratio"),
        F.round("pnl_without_top_one_percent", 5).alias("pnl_without_top_one_percent"),
        F.round("largest_month_pnl_share", 9).alias("largest_month_pnl_share"),
    )


@query(
    "maker_gate",
    "A36",
    f"""WITH {CONCENTRATION},
    s AS (SELECT side, count(*) AS total, count(*) FILTER (WHERE outcome = 1) AS up, count(*) FILTER (WHERE outcome = 0) AS down,
                 (sum(shares * (p_fair - entry_price) - fee + rebate)) / sum(shares) AS ev FROM maker GROUP BY 1)
    SELECT s.side, concat_ws(',', CASE WHEN total < 500 THEN 'insufficient_total_fills' END, CASE WHEN up < 150 THEN 'insufficient_up_fills' END,
             CASE WHEN down < 150 THEN 'insufficient_down_fills' END, CASE WHEN ev < 0.005 THEN 'net_ev_per_share_below_threshold' END,
             CASE WHEN ev - 0.01 <= 0 THEN 'net_ev_ci_lower_not_positive' END, CASE WHEN pnl_without_top_one_percent <= 0 THEN 'top_one_percent_removal_not_positive' END,
             CASE WHEN positive_week_ratio < 0.7 THEN 'insufficient_positive_test_weeks' END, CASE WHEN largest_month_pnl_share > 0.5 THEN 'single_month_pnl_concentration' END,
             CASE WHEN ev - 0.2 <= 0 THEN 'capacity_ci_lower_not_positive' END, CASE WHEN s.side = 'up' THEN 'rebate_free_requirement_failed' END) AS failed_conditions
    FROM s JOIN conc USING (side)""",
)
def _gate(t: Tables):
    shares = F.sum("shares")
    net = F.sum(F.col("shares") * (F.col("p_fair") - F.col("entry_price")) - F.col("fee") + F.col("rebate"))
    sums = maker(t).groupBy("side").agg(
        F.count(F.lit(1)).alias("total_fills"),
        F.count(F.when(F.col("outcome") == 1, 1)).alias("up_fills"),
        F.count(F.when(F.col("outcome") == 0, 1)).alias("down_fills"),
        (net / shares).alias("net_ev_per_filled_share"),
    )
    evidence = sums.join(concentration(t), "side").withColumns(
        {
            "net_ev_ci_lower": F.col("net_ev_per_filled_share") - 0.01,
            "capacity_net_edge_ci_lower": F.col("net_ev_per_filled_share") - 0.2,
            "rebate_free": F.col("side") != "up",
            "pessimistic_queue": F.lit(True),
            "p99_latency": F.lit(True),
            "trade_order_robust": F.lit(True),
        }
    )
    return ev.maker_gate(evidence).select("side", F.concat_ws(",", "failed_conditions").alias("failed_conditions"))


DRAWS = """daily_n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY g) AS days FROM daily),
slots AS (
  SELECT g, days, b, slot FROM (SELECT DISTINCT g, days FROM daily_n), (SELECT unnest(range(0, {b})) AS b), LATERAL (SELECT unnest(range(0, days)) AS slot)),
drawn AS (
  SELECT s.g, s.b, d.* EXCLUDE (g) FROM (SELECT *, CAST('0x' || substr(md5('{seed}:' || b || ':' || slot), 1, 8) AS BIGINT) % days AS pick FROM slots) s
  JOIN daily_n d ON d.g = s.g AND d.i = s.pick)"""


@query(
    "bootstrap_entry_value",
    "A22",
    f"""WITH {CANDIDATES}, priced AS (SELECT *, outcome - entry_price AS pnl FROM candidates),
    daily AS (SELECT regime AS g, decision_ts // {DAY_NS} AS day, sum(pnl) AS s, count(*) AS n FROM priced WHERE regime IS NOT NULL GROUP BY 1, 2),
    {DRAWS.format(b=1000, seed=17)},
    means AS (SELECT g, b, sum(s) / sum(n) AS m FROM drawn GROUP BY 1, 2)
    SELECT g AS regime, round(quantile_cont(m, 0.025), 6) AS ci95_lower, round(quantile_cont(m, 0.975), 6) AS ci95_upper FROM means GROUP BY 1""",
)
def _bootstrap(t: Tables):
    rows = candidates(t).filter("regime IS NOT NULL")
    out = ev.bootstrap_mean_ci(rows, value="pnl_per_share", ts="decision_ts", by=["regime"])
    return rounded(out, 6)


PAIRS = """pairs AS (
  SELECT doc_id AS sample, least(0.99, greatest(0.01, n_chars % 100 / 100.0)) AS p_c, 0.6 AS p_b, quality AS y, 1 + toxic AS w,
         doc_id // 20 * {day} AS ts FROM documents JOIN labels USING (doc_id))"""


def paired_rows(t: Tables):
    docs = t.read("documents").select("doc_id", "n_chars").join(t.read("labels"), "doc_id")
    chars = (F.col("n_chars") % 100).cast("double") / 100.0
    base = docs.select(
        F.col("doc_id").alias("sample"),
        F.least(F.lit(0.99), F.greatest(F.lit(0.01), chars)).alias("p_up"),
        F.col("quality").alias("y"),
        (1 + F.col("toxic")).alias("w"),
        (F.floor(F.col("doc_id") / 20) * DAY_NS).alias("ts"),
    )
    flat = docs.select(F.col("doc_id").alias("sample"), F.lit(0.6).alias("p_up"), F.col("quality").alias("y"))
    return ev.paired_predictions(base, flat, sample="sample", p="p_up", y="y", keep=["w", "ts"])


@query(
    "paired_predictions",
    "J9 U5",
    f"""WITH {PAIRS.format(day=DAY_NS)} SELECT sample, CAST(p_c AS DOUBLE) AS p_candidate, CAST(p_b AS DOUBLE) AS p_baseline, y, w, ts FROM pairs""",
)
def _pairs(t: Tables):
    return paired_rows(t)


@query(
    "paired_bootstrap",
    "A23",
    f"""WITH {PAIRS.format(day=DAY_NS)},
    loss AS (SELECT *, -(y * ln(p_b) + (1 - y) * ln(1 - p_b)) + (y * ln(p_c) + (1 - y) * ln(1 - p_c)) AS ll, (y - p_b) ** 2 - (y - p_c) ** 2 AS br FROM pairs),
    daily AS (SELECT 0 AS g, ts // {DAY_NS} AS day, sum(w) AS w, sum(w * ll) AS ll, sum(w * br) AS br FROM loss GROUP BY 1, 2),
    {DRAWS.format(b=2000, seed=17)},
    boot AS (SELECT b, sum(ll) / sum(w) AS l, sum(br) / sum(w) AS r FROM drawn GROUP BY 1),
    ci AS (SELECT quantile_cont(l, 0.025) AS l0, quantile_cont(l, 0.975) AS l1, quantile_cont(r, 0.025) AS r0, quantile_cont(r, 0.975) AS r1 FROM boot)
    SELECT round(sum(ll) / sum(w), 6) AS log_loss_improvement, round(sum(br) / sum(w), 6) AS brier_improvement, count(*) AS days,
           round(max(l0), 6) AS log_loss_ci_lower, round(max(l1), 6) AS log_loss_ci_upper, round(max(r0), 6) AS brier_ci_lower, round(max(r1), 6) AS brier_ci_upper
    FROM daily, ci""",
)
def _paired(t: Tables):
    return rounded(ev.paired_bootstrap(paired_rows(t), y="y", weight="w", ts="ts", iterations=2_000), 6)


def _sweep_sql(by: str) -> str:
    return f"""laddered AS (SELECT c.*, t.threshold FROM candidates c, (SELECT CAST(unnest([0.0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.075, 0.10]) AS DOUBLE) AS threshold) t WHERE regime IS NOT NULL),
    {persistent_sql("laddered", "predicted_edge >= threshold", by=f"{by}, threshold, market", signals=1)},
    m AS (SELECT {by}, threshold, {METRICS}, count(*) / (SELECT count(DISTINCT market) FROM candidates WHERE regime IS NOT NULL) AS market_coverage FROM chosen GROUP BY {by}, threshold),
    daily AS (SELECT {by} || ':' || threshold AS g, decision_ts // {DAY_NS} AS day, sum(pnl_per_share) AS s, count(*) AS n FROM chosen GROUP BY 1, 2),
    {DRAWS.format(b=1000, seed=17)},
    means AS (SELECT g, b, sum(s) / sum(n) AS mean FROM drawn GROUP BY 1, 2),
    ci AS (SELECT g, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM means GROUP BY 1),
    sweep AS (SELECT m.*, round(ci.lo, 6) AS ci95_lower, round(ci.hi, 6) AS ci95_upper FROM m JOIN ci ON ci.g = m.{by} || ':' || m.threshold)"""


def sweep(t: Tables):
    rows = candidates(t).filter("regime IS NOT NULL").select(
        "market", "decision_ts", "side", "entry_price", "predicted_edge", "outcome", "pnl_per_share", "regime", "event_id"
    )
    rows = settle(rows)
    return ev.threshold_sweep(
        rows, market="market", ts="decision_ts", requested_markets=rows.select("market").distinct().count(), signals=1,
        max_gap=8 * HOUR, width=TICK_CHUNK, by=["regime"],
    )


@query("threshold_sweep", "A25", f"WITH {CANDIDATES}, {_sweep_sql('regime')} SELECT * FROM sweep")
def _sweep(t: Tables):
    out = sweep(t)
    return out.select(
        "regime", "threshold", "entry_count", "market_coverage",
        *[F.round(c, 9).alias(c) for c in ("win_rate", "average_entry_price", "average_predicted_edge", "realized_ev_per_share", "profit_factor")],
        *[F.round(c, 6).alias(c) for c in ("ci95_lower", "ci95_upper")],
    )


@query(
    "picked_thresholds",
    "A25",
    f"""WITH {CANDIDATES}, {_sweep_sql('regime')}
    SELECT regime, arg_max(threshold, (ci95_lower, realized_ev_per_share, -threshold)) AS threshold,
           arg_max(entry_count, (ci95_lower, realized_ev_per_share, -threshold)) AS entry_count
    FROM (SELECT * REPLACE (ci95_lower + 1 AS ci95_lower) FROM sweep) WHERE entry_count >= 5 AND ci95_lower > 0 GROUP BY 1""",
)
def _picked(t: Tables):
    # Bounds are lifted by one so that the rule has something to choose from on random prices.
    lifted = sweep(t).withColumns(
        {"ci95_lower": F.round("ci95_lower", 6) + 1, "realized_ev_per_share": F.round("realized_ev_per_share", 9)}
    )
    return ev.pick_threshold(lifted, min_entries=5, by=["regime"]).select("regime", "threshold", "entry_count")


@query(
    "entry_diagnostics",
    "A24",
    f"""WITH {CANDIDATES}
    SELECT side, count(*) AS n, max(price_age_ns) AS age_max, quantile_cont(price_age_ns, 0.5) AS age_median, round(quantile_cont(price_age_ns, 0.95), 0) AS age_p95
    FROM candidates GROUP BY 1""",
)
def _diagnostics(t: Tables):
    out = ev.entry_diagnostics(candidates(t), by=["side"], age="price_age_ns", width=float(HOUR))
    return out.withColumns(
        {"age_median": F.col("age_median").cast("double"), "age_p95": F.round(F.col("age_p95").cast("double"), 0)}
    )


@query(
    "sensitivity_grid",
    "A26",
    f"""WITH {CANDIDATES},
    s AS (SELECT * FROM (VALUES ('base', 0.0, {12 * HOUR}), ('cost', 0.01, {12 * HOUR}), ('fresh', 0.0, {4 * HOUR}), ('both', 0.01, {4 * HOUR})) AS v(scenario, extra, age)),
    adj AS (
      SELECT c.* REPLACE (least(0.999999, entry_price + CAST(extra AS DOUBLE)) AS entry_price, predicted_edge - CAST(extra AS DOUBLE) AS predicted_edge), scenario
      FROM candidates c, s WHERE price_age_ns <= age),
    {persistent_sql("adj", "predicted_edge >= 0.1", by="scenario, market", signals=1)}
    SELECT scenario, {METRICS} FROM chosen GROUP BY 1""",
)
def _grid(t: Tables):
    rows = candidates(t).select(
        "market", "decision_ts", "side", "entry_price", "predicted_edge", "outcome", "pnl_per_share", "price_age_ns", "event_id"
    )
    scenarios = [
        {"scenario": "base", "extra_cost": 0.0, "max_age": 12 * HOUR},
        {"scenario": "cost", "extra_cost": 0.01, "max_age": 12 * HOUR},
        {"scenario": "fresh", "extra_cost": 0.0, "max_age": 4 * HOUR},
        {"scenario": "both", "extra_cost": 0.01, "max_age": 4 * HOUR},
    ]
    entries = first_persistent_entry(
        sensitivity(rows, scenarios), market=["scenario", "market"], ts="decision_ts", side="side",
        passes=F.col("predicted_edge") >= 0.1, signals=1, max_gap=8 * HOUR, width=TICK_CHUNK,
    )
    return rounded(entry_metrics(entries, ["scenario"]))


@query(
    "regime_threshold_entries",
    "W5",
    f"""WITH {CANDIDATES},
    kept AS (SELECT * FROM candidates WHERE predicted_edge >= CASE regime WHEN 'early_3s_to_30s' THEN 0.15 WHEN 'price_discovery_35s_to_90s' THEN 0.05 END),
    {persistent_sql("kept", "true", by="market", signals=2, gap=20 * HOUR)}
    SELECT market, decision_ts, side, regime, entry_price FROM chosen""",
)
def _regimes(t: Tables):
    floor_ = F.when(F.col("regime") == "early_3s_to_30s", 0.15).when(F.col("regime") == "price_discovery_35s_to_90s", 0.05)
    return first_persistent_entry(
        candidates(t), market="market", ts="decision_ts", side="side", passes=F.col("predicted_edge") >= floor_,
        signals=2, max_gap=20 * HOUR, width=TICK_CHUNK, drop_failing_first=True,
    ).select("market", "decision_ts", "side", "regime", "entry_price")


@query(
    "candidate_selection",
    "K4",
    f"""WITH {FORECASTS},
    s AS (
      SELECT market % 9 AS id, round(avg({LL}), 6) AS ll, round(avg((p_up - outcome) ** 2), 6) AS br, round(abs(avg(p_up) - avg(outcome)), 6) AS ce FROM forecasts GROUP BY 1),
    k AS (SELECT 'model' || id AS name, CASE WHEN id < 5 THEN 'logistic' ELSE 'lightgbm' END AS kind, ll, br, ce, CASE WHEN id <> 8 THEN 0.001 ELSE -0.001 END AS lo FROM s),
    best AS (SELECT * FROM k WHERE kind = 'logistic' ORDER BY ll, br, ce, name LIMIT 1),
    w AS (SELECT k.* FROM k, best WHERE k.kind = 'lightgbm' AND k.ll < best.ll AND k.br < best.br AND k.ce < best.ce AND k.lo > 0 ORDER BY k.ll, k.br, k.ce, k.name LIMIT 1)
    SELECT coalesce(w.name, best.name) AS selected_name, best.name AS best_logistic_name,
           CASE WHEN w.name IS NULL THEN 'no_lightgbm_candidate_met_replacement_rule' ELSE 'lightgbm_met_replacement_rule' END AS reason
    FROM best LEFT JOIN w ON true""",
)
def _selection(t: Tables):
    y, p = F.col("outcome"), F.col("p_up")
    scored = t.forecasts.groupBy((F.col("market") % 9).alias("id")).agg(
        F.round(F.avg(ev.log_loss(p, y)), 6).alias("log_loss"),
        F.round(F.avg((p - y) * (p - y)), 6).alias("brier"),
        F.round(F.abs(F.avg(p) - F.avg(y)), 6).alias("calibration_error"),
    )
    models = scored.select(
        F.concat(F.lit("model"), F.col("id").cast("string")).alias("name"),
        F.when(F.col("id") < 5, "logistic").otherwise("lightgbm").alias("kind"),
        "log_loss", "brier", "calibration_error",
        F.when(F.col("id") != 8, 0.001).otherwise(-0.001).alias("log_loss_ci_lower"),
        F.when(F.col("id") != 8, 0.001).otherwise(-0.001).alias("brier_ci_lower"),
    )
    best = models.filter("kind = 'logistic'").agg(
        F.min_by("name", F.struct("log_loss", "brier", "calibration_error", "name")).alias("paired_baseline")
    )
    return ev.select_candidate(beside(models, best))


