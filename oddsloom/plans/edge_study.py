"""Forecast against token prices: candidates, entries, thresholds, scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsloom.operators.asof import asof_backward
from oddsloom.operators.edge import (
    dual_token_prices,
    edge_candidates,
    entry_metrics,
    first_persistent_entry,
    regime,
)
from oddsloom.plans.analogs import DAY_NS, TICK_CHUNK, TICKS, Tables
from oddsloom.plans.registry import query

HOUR = 3_600_000_000_000
UNIT = 480_000_000_000  # one elapsed unit: a day stands for 180 seconds


@query(
    "asof_backward",
    "J1",
    f"""WITH {TICKS},
    q AS (SELECT user_id, ts_ns, price FROM ticks WHERE event_type = 'view'),
    d AS (SELECT user_id, ts_ns, event_id FROM ticks WHERE event_type = 'purchase'),
    e AS (SELECT user_id, max(ts_ns) AS last_ns FROM q GROUP BY user_id)
    SELECT d.event_id, d.user_id, d.ts_ns,
           CASE WHEN d.ts_ns <= e.last_ns THEN q.price END AS price,
           CASE WHEN d.ts_ns <= e.last_ns THEN q.ts_ns END AS quote_ts
    FROM d ASOF LEFT JOIN q ON d.user_id = q.user_id AND d.ts_ns >= q.ts_ns
    LEFT JOIN e ON d.user_id = e.user_id""",
)
def _asof(t: Tables):
    quotes = t.ticks.filter("event_type = 'view'").select(
        "user_id", F.col("ts_ns").alias("quote_ts"), "price", "event_id"
    )
    probes = t.ticks.filter("event_type = 'purchase'").select("event_id", "user_id", "ts_ns")
    return asof_backward(
        probes, quotes, "user_id", "ts_ns", "quote_ts", ["price"], TICK_CHUNK,
        right_tie=["event_id"], mask_after_last=True,
    )


def decisions(t: Tables):
    """One forecast per view or signup; the market is a user's day, the down token the next user."""
    start = F.col("ts_ns") - F.pmod(F.col("ts_ns"), F.lit(DAY_NS))
    rows = t.ticks.filter(F.col("event_type").isin("view", "signup"))
    return rows.select(
        F.col("user_id").alias("up_token"),
        (F.col("user_id") + 1).alias("down_token"),
        start.alias("t0"),
        F.concat_ws("@", F.col("user_id").cast("string"), (start / F.lit(DAY_NS)).cast("int").cast("string")).alias("market"),
        F.col("ts_ns").alias("decision_ts"),
        ((F.col("size") + 0.5) / 100).alias("p_up"),
        (F.col("event_id") % 2).cast("int").alias("label"),
        ((F.col("ts_ns") - start) / F.lit(UNIT)).alias("elapsed"),
        "event_id",
    )


def candidates(t: Tables):
    prices = t.ticks.filter(F.col("event_type").isin("click", "purchase", "error"))
    quoted = dual_token_prices(
        decisions(t), prices, up="up_token", down="down_token", decision_ts="decision_ts",
        market_start="t0", token="user_id", price_ts="ts_ns", price="price", tie=["event_id"],
        max_age=12 * HOUR, width=TICK_CHUNK,
    )
    return edge_candidates(quoted, p_up="p_up", label="label", buffer=0.01).withColumn(
        "regime", regime(F.col("elapsed"))
    )


CANDIDATES = f"""{TICKS},
decisions AS (
  SELECT user_id AS up_token, user_id + 1 AS down_token, ts_ns - ts_ns % {DAY_NS} AS t0,
         concat_ws('@', CAST(user_id AS VARCHAR), CAST(ts_ns // {DAY_NS} AS VARCHAR)) AS market,
         ts_ns AS decision_ts, (size + 0.5) / 100 AS p_up, CAST(event_id % 2 AS INTEGER) AS label,
         (ts_ns % {DAY_NS}) / {UNIT} AS elapsed
  FROM ticks WHERE event_type IN ('view', 'signup')),
prices AS (SELECT user_id, ts_ns, price FROM ticks WHERE event_type IN ('click', 'purchase', 'error')),
quoted AS (
  SELECT d.*, u.price AS up_price, u.ts_ns AS up_ts, w.price AS down_price, w.ts_ns AS down_ts,
         d.decision_ts - least(u.ts_ns, w.ts_ns) AS price_age_ns
  FROM decisions d
  ASOF JOIN prices u ON d.up_token = u.user_id AND d.decision_ts >= u.ts_ns
  ASOF JOIN prices w ON d.down_token = w.user_id AND d.decision_ts >= w.ts_ns
  WHERE u.ts_ns >= d.t0 AND w.ts_ns >= d.t0
    AND d.decision_ts - least(u.ts_ns, w.ts_ns) <= {12 * HOUR}),
entries AS (
  SELECT *, least(0.999999, up_price + 0.01) AS up_entry, least(0.999999, down_price + 0.01) AS down_entry
  FROM quoted),
edges AS (SELECT *, p_up - up_entry AS up_edge, 1.0 - p_up - down_entry AS down_edge FROM entries),
candidates AS (
  SELECT market, decision_ts, price_age_ns, elapsed,
         CASE WHEN up_edge >= down_edge THEN 'up' ELSE 'down' END AS side,
         CASE WHEN up_edge >= down_edge THEN p_up ELSE 1.0 - p_up END AS p_side,
         CASE WHEN up_edge >= down_edge THEN up_price ELSE down_price END AS observed_token_price,
         CASE WHEN up_edge >= down_edge THEN up_entry ELSE down_entry END AS entry_price,
         greatest(up_edge, down_edge) AS predicted_edge,
         CASE WHEN up_edge >= down_edge THEN label ELSE 1 - label END AS outcome,
         CASE WHEN elapsed BETWEEN 3 AND 30 THEN 'early_3s_to_30s'
              WHEN elapsed > 30 AND elapsed <= 90 THEN 'price_discovery_35s_to_90s'
              WHEN elapsed > 90 AND elapsed <= 180 THEN 'mid_early_95s_to_180s' END AS regime
  FROM edges)"""


@query(
    "edge_candidates",
    "J2 F10 F11",
    f"""WITH {CANDIDATES}
    SELECT market, decision_ts, side, p_side, observed_token_price, entry_price, predicted_edge, outcome,
           outcome - entry_price AS pnl_per_share, regime, price_age_ns FROM candidates""",
)
def _candidates(t: Tables):
    return candidates(t).select(
        "market", "decision_ts", "side", "p_side", "observed_token_price", "entry_price",
        "predicted_edge", "outcome", "pnl_per_share", "regime", "price_age_ns",
    )


def persistent_sql(source: str, test: str, by: str = "market", signals: int = 2, gap: int = 8 * HOUR) -> str:
    """Runs of same-side signals; `test` marks passing rows, failing ones end a run."""
    return f"""tested AS (SELECT *, ({test}) AS ok FROM {source}),
    linked AS (
      SELECT *, coalesce(ok AND lag(ok) OVER w AND lag(side) OVER w = side
                 AND decision_ts - lag(decision_ts) OVER w > 0
                 AND decision_ts - lag(decision_ts) OVER w <= {gap}, false) AS link
      FROM tested WINDOW w AS (PARTITION BY {by} ORDER BY decision_ts, side)),
    islands AS (
      SELECT *, sum(CASE WHEN link THEN 0 ELSE 1 END) OVER (PARTITION BY {by} ORDER BY decision_ts, side) AS island
      FROM linked),
    runs AS (
      SELECT *, row_number() OVER (PARTITION BY {by}, island ORDER BY decision_ts, side) AS run FROM islands),
    firsts AS (
      SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY decision_ts, side) AS nth
      FROM runs WHERE ok AND run >= {signals}),
    chosen AS (SELECT *, outcome - entry_price AS pnl_per_share FROM firsts WHERE nth = 1)"""


METRICS = """count(*) AS entry_count, round(avg(outcome), 9) AS win_rate, round(avg(entry_price), 9) AS average_entry_price,
    round(avg(predicted_edge), 9) AS average_predicted_edge, round(avg(pnl_per_share), 9) AS realized_ev_per_share,
    round(CASE WHEN sum(CASE WHEN pnl_per_share < 0 THEN -pnl_per_share ELSE 0 END) > 0
         THEN sum(CASE WHEN pnl_per_share > 0 THEN pnl_per_share ELSE 0 END)
              / sum(CASE WHEN pnl_per_share < 0 THEN -pnl_per_share ELSE 0 END) END, 9) AS profit_factor"""


def rounded(df, digits=9):
    """Round the double columns, for comparison across engines that add in another order."""
    return df.select(
        *[F.round(c, digits).alias(c) if d == "double" else F.col(c) for c, d in df.dtypes]
    )


@query(
    "edge_entry_study",
    "J1 J2 F11 W4 A21",
    f"""WITH {CANDIDATES}, {persistent_sql("candidates", "predicted_edge >= 0.1")}
    SELECT {METRICS} FROM chosen""",
)
def _study(t: Tables):
    entries = first_persistent_entry(
        candidates(t), market="market", ts="decision_ts", side="side",
        passes=F.col("predicted_edge") >= 0.1, signals=2, max_gap=8 * HOUR, width=TICK_CHUNK,
    )
    return rounded(entry_metrics(entries))


@query(
    "persistent_entries",
    "W4",
    f"""WITH {CANDIDATES}, {persistent_sql("candidates", "predicted_edge >= 0.1")}
    SELECT market, decision_ts, side, entry_price, predicted_edge, outcome FROM chosen""",
)
def _entries(t: Tables):
    return first_persistent_entry(
        candidates(t), market="market", ts="decision_ts", side="side",
        passes=F.col("predicted_edge") >= 0.1, signals=2, max_gap=8 * HOUR, width=TICK_CHUNK,
    ).select("market", "decision_ts", "side", "entry_price", "predicted_edge", "outcome")
