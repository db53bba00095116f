"""Rankings, grids, coverage, pruning."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsloom.functions.integers import floor_div
from oddsloom.operators import markets as mk
from oddsloom.operators import selection as sl
from oddsloom.plans.analogs import DAY_NS, FILLS, TICK_CHUNK, TICKS, Tables
from oddsloom.plans.edge_study import rounded
from oddsloom.plans.registry import query

HOUR = 3_600_000_000_000
EPOCH_2024 = 1_704_067_200_000_000_000
LOOKBACK = 12 * DAY_NS

ANALYSIS = f"""{TICKS},
prints AS (SELECT user_id // 2 AS market, user_id % 2 AS token, ts_ns, event_id, price FROM ticks WHERE side <> 'mint'),
m AS (SELECT market, max(ts_ns) AS window_end, CASE WHEN market % 3 > 0 THEN max(ts_ns) - {5 * DAY_NS} END AS activation_start, CAST(market % 7 AS DOUBLE) AS volume, market // 4 AS event FROM prints GROUP BY market),
j AS (SELECT p.*, window_end, activation_start, lag(price) OVER w AS was, lag(ts_ns) OVER w AS was_ts FROM prints p JOIN m USING (market) WINDOW w AS (PARTITION BY market, token ORDER BY ts_ns, event_id)),
i AS (SELECT *, activation_start IS NULL OR ts_ns >= activation_start AS act FROM j WHERE ts_ns >= window_end - {LOOKBACK} AND ts_ns <= window_end),
a AS (
  SELECT market, token, count(*) AS window_trades, arg_min(price, (ts_ns, event_id)) AS first_window_price, max(price) AS max_window_price, arg_max(price, (ts_ns, event_id)) AS last_window_price,
         count(*) FILTER (WHERE act) AS activation_trades, arg_min(price, (ts_ns, event_id)) FILTER (WHERE act) AS first_activation_price, max(price) FILTER (WHERE act) AS max_activation_price,
         arg_max(price, (ts_ns, event_id)) FILTER (WHERE act) AS last_activation_price,
         min(ts_ns) FILTER (WHERE act AND was < 0.3 AND price >= 0.3 AND was_ts >= window_end - {LOOKBACK}) AS entry_cross_ts
  FROM i GROUP BY 1, 2)"""


def analysis_inputs(t: Tables):
    prints = t.ticks.filter("side <> 'mint'").select(
        floor_div("user_id", 2).alias("market"), (F.col("user_id") % 2).alias("token"), "ts_ns", "event_id", "price"
    )
    ends = prints.groupBy("market").agg(F.max("ts_ns").alias("last"))
    bounds = mk.window_bounds(F.col("last"), F.lit(None).cast("bigint"), 120.0, F.lit(0))
    markets = ends.select(
        "market",
        F.when(F.col("market") % 3 > 0, bounds["activation_start"]).alias("activation_start"),
        bounds["window_end"].alias("window_end"),
        (F.col("market") % 7).cast("double").alias("volume"),
        floor_div("market", 4).alias("event"),
    )
    return prints, markets


def analysis(t: Tables):
    prints, markets = analysis_inputs(t)
    return sl.trade_window_analysis(
        prints, markets, market="market", token="token", ts="ts_ns", tie=["event_id"], price="price", entry_price=0.3,
        lookback_ns=LOOKBACK, width=TICK_CHUNK,
    )


@query("trade_window_analysis", "A35 X8", f"WITH {ANALYSIS} SELECT * FROM a")
def _analysis(t: Tables):
    return analysis(t)


@query(
    "best_token",
    "K1",
    f"""WITH {ANALYSIS},
    r AS (SELECT a.*, volume, row_number() OVER (PARTITION BY market ORDER BY entry_cross_ts IS NULL, entry_cross_ts, CASE WHEN entry_cross_ts IS NULL THEN -coalesce(max_activation_price, 0) END,
            -activation_trades, -volume, token) AS n FROM a JOIN m USING (market))
    SELECT market, token, entry_cross_ts, max_activation_price, activation_trades, volume FROM r WHERE n = 1""",
)
def _best(t: Tables):
    _, markets = analysis_inputs(t)
    rows = analysis(t).join(markets.select("market", "volume"), "market")
    return sl.best_token(rows, market="market", token="token", volume="volume").select(
        "market", "token", "entry_cross_ts", "max_activation_price", "activation_trades", "volume"
    )


@query(
    "breakout_per_game",
    "K2",
    f"""WITH {ANALYSIS},
    b AS (SELECT a.*, volume, event FROM a JOIN m USING (market) WHERE token = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY entry_cross_ts IS NULL, entry_cross_ts, CASE WHEN entry_cross_ts IS NULL THEN first_window_price END, -volume, market) AS n,
                 count(*) OVER (PARTITION BY event) AS c, sum(volume) OVER (PARTITION BY event) AS event_total_volume,
                 first_value(market) OVER (PARTITION BY event ORDER BY first_window_price DESC, market) AS opponent, max(first_window_price) OVER (PARTITION BY event) AS opponent_first_window_price FROM b)
    SELECT event, market, entry_cross_ts, first_window_price, opponent, opponent_first_window_price, event_total_volume FROM r WHERE n = 1 AND c >= 2
    ORDER BY event_total_volume DESC, event LIMIT 10""",
)
def _games(t: Tables):
    _, markets = analysis_inputs(t)
    rows = analysis(t).filter("token = 0").join(markets.select("market", "volume", "event"), "market")
    return sl.breakout_per_game(rows, event="event", market="market", volume="volume", limit=10)


@query(
    "display_markets",
    "K5",
    f"""WITH {FILLS}, r AS (SELECT market, max(price) - min(price) AS price_range FROM fills GROUP BY 1), t AS (SELECT DISTINCT market FROM fills WHERE line_no = 7)
    SELECT r.market, round(price_range, 6) AS price_range, CASE WHEN t.market IS NULL THEN 0 ELSE 1 END AS traded FROM r LEFT JOIN t ON r.market = t.market ORDER BY traded DESC, r.price_range DESC, r.market LIMIT 25""",
)
def _display(t: Tables):
    out = sl.display_markets(t.fills, t.fills.filter("line_no = 7"), market="market", price="price", limit=25)
    return out.withColumn("price_range", F.round("price_range", 6))


@query(
    "downsampled_prices",
    "K6",
    f"""WITH {TICKS},
    p AS (SELECT event_type, event_id, ts_ns, price, event_id % 97 = 0 AS keep, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM ticks WINDOW w AS (PARTITION BY event_type ORDER BY ts_ns, event_id)),
    x AS (SELECT event_type, arg_min(pos, (price, pos)) AS lo, arg_min(pos, (-price, pos)) AS hi FROM p GROUP BY 1),
    m AS (SELECT p.*, keep OR pos = 0 OR pos = n - 1 OR pos = lo OR pos = hi AS must FROM p JOIN x USING (event_type)),
    c AS (SELECT event_type, count(*) FILTER (WHERE must) AS mk, max(n) AS n FROM m GROUP BY 1),
    s AS (SELECT *, greatest(1, n // greatest(100, 150 - mk)) AS stride FROM c),
    z AS (SELECT m.*, s.mk, s.stride FROM m JOIN s USING (event_type)),
    k AS (SELECT event_type, count(*) FILTER (WHERE must OR pos % stride = 0) AS picked, count(*) FILTER (WHERE pos % stride = 0) AS strided FROM z GROUP BY 1)
    SELECT event_type, event_id, pos AS bar FROM z JOIN k USING (event_type)
    WHERE CASE WHEN n <= 150 THEN true WHEN picked > 150 THEN must OR pos % (stride * CASE WHEN 150 - mk > 0 THEN greatest(1, strided // (150 - mk)) ELSE n END) = 0 ELSE must OR pos % stride = 0 END""",
)
def _down(t: Tables):
    rows = t.ticks.select("event_type", "event_id", "ts_ns", "price")
    out = sl.downsample(
        rows, keys=["event_type"], order=["ts_ns", "event_id"], value="price", max_points=150, width=TICK_CHUNK,
        keep=F.col("event_id") % 97 == 0,
    )
    return out.select("event_type", "event_id", "bar")


@query(
    "last_price_per_bucket",
    "K7",
    f"""WITH {TICKS} SELECT user_id, ts_ns // {6 * HOUR} * {6 * HOUR} AS bucket_ts, arg_max(price, (ts_ns, event_id)) AS price FROM ticks GROUP BY 1, 2""",
)
def _buckets(t: Tables):
    return sl.last_per_bucket(t.ticks, keys=["user_id"], ts="ts_ns", tie=["event_id"], value="price", bucket_ns=6 * HOUR)


GRID = """g AS (SELECT DISTINCT l_partkey AS market, w AS "window", h AS threshold FROM lineitem, (SELECT unnest([10, 20, 10, 40]) AS w), (SELECT unnest([1, 2, 3]) AS h)),
params AS (SELECT *, '{"market":' || market || ',"threshold":' || threshold || ',"window":' || "window" || '}' AS params FROM g)"""


def grid(t: Tables):
    base = t.read("lineitem").select(F.col("l_partkey").alias("market")).distinct()
    return sl.parameter_grid(base, {"window": [10, 20, 10, 40], "threshold": [1, 2, 3]})


@query("parameter_grid", "U3 E4", f'WITH {GRID} SELECT market, "window", threshold, params FROM params')
def _grid(t: Tables):
    return grid(t)


@query(
    "grid_subset",
    "K8",
    f'WITH {GRID} SELECT market, "window", threshold FROM params ORDER BY md5(\'7:\' || params) LIMIT 12',
)
def _subset(t: Tables):
    return sl.grid_subset(grid(t), columns=["market", "window", "threshold"], seed=7, limit=12).select("market", "window", "threshold")


TRIALS = """runs AS (
  SELECT o_custkey AS trial, CASE WHEN year(o_orderdate) < 1999 THEN 'train' ELSE 'holdout' END AS split, year(o_orderdate) AS yr,
         CAST(sum(CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice) ELSE -floor(o_totalprice) END) AS DOUBLE) / 1000 AS pnl, CAST(max(floor(o_totalprice)) AS DOUBLE) / 1000 AS max_drawdown,
         count(*) AS fills, CAST(min(o_orderkey % 100) AS DOUBLE) / 100 AS coverage, max(o_orderkey % 50) = 49 AS terminated_early
  FROM orders GROUP BY 1, 2, 3),
scored AS (SELECT *, pnl - 0.5 * max_drawdown - CASE WHEN terminated_early THEN 100.0 ELSE 0.0 END - 100.0 * greatest(0, CAST(0.98 AS DOUBLE) - coverage) * 10 - CASE WHEN fills < 2 THEN 2.0 ELSE 0.0 END AS score FROM runs)"""


def runs(t: Tables):
    k, price = F.col("o_orderkey"), F.floor("o_totalprice")
    year = F.year("o_orderdate")
    out = t.read("orders").groupBy(
        F.col("o_custkey").alias("trial"), F.when(year < 1999, "train").otherwise("holdout").alias("split"), year.alias("yr")
    ).agg(
        (F.sum(F.when(k % 2 == 0, price).otherwise(-price)).cast("double") / 1000).alias("pnl"),
        (F.max(price).cast("double") / 1000).alias("max_drawdown"),
        F.count(F.lit(1)).alias("fills"),
        (F.min(k % 100).cast("double") / 100).alias("coverage"),
        (F.max(k % 50) == 49).alias("terminated_early"),
    )
    return out.withColumn("score", sl.trial_scores(out, initial_cash=100.0, min_fills=2))


@query("trial_scores", "A28", f"WITH {TRIALS} SELECT trial, split, yr, round(score, 6) AS score FROM scored")
def _trial_scores(t: Tables):
    return runs(t).select("trial", "split", F.col("yr").cast("bigint").alias("yr"), F.round("score", 6).alias("score"))


BOARD = f"""{TRIALS},
board AS (
  SELECT trial, {", ".join(f"median({m}) FILTER (WHERE split = '{s}') AS {s}_median_{m}" for m in ("score", "pnl", "max_drawdown", "fills", "coverage") for s in ("train", "holdout"))}
  FROM scored GROUP BY 1)"""


@query(
    "leaderboard",
    "A29 K3 S14",
    f"""WITH {BOARD} SELECT trial, {", ".join(f"round({s}_median_{m}, 6) AS {s}_median_{m}" for m in ("score", "pnl", "max_drawdown", "fills", "coverage") for s in ("train", "holdout"))} FROM board""",
)
def _board(t: Tables):
    board = sl.leaderboard(runs(t), trial="trial")
    return rounded(sl.ranked(board, trial="trial"), 6)


@query(
    "promoted_trials",
    "K3",
    f"""WITH {BOARD}, p AS (SELECT trial, train_median_score AS s FROM board WHERE train_median_score IS NOT NULL) SELECT trial, round(s, 6) AS train_median_score FROM p ORDER BY s DESC, trial LIMIT 20""",
)
def _promoted(t: Tables):
    board = sl.leaderboard(runs(t), trial="trial").filter("train_median_score IS NOT NULL")
    return sl.promoted(board, trial="trial", k=20).select("trial", F.round("train_median_score", 6).alias("train_median_score"))


SEARCH_SPLIT = EPOCH_2024 + 20 * DAY_NS
SEARCH = f"""{TICKS},
p AS (SELECT k AS trial, CAST(0.02 AS DOUBLE) * k AS drop FROM (SELECT unnest(range(1, 9)) AS k)),
moves AS (SELECT user_id, ts_ns, event_id, lead(price) OVER w - price AS gain, lag(price) OVER w - price AS fell FROM ticks WINDOW w AS (PARTITION BY user_id ORDER BY ts_ns, event_id)),
ev AS (
  SELECT trial, CASE WHEN ts_ns < {SEARCH_SPLIT} THEN 'train' ELSE 'holdout' END AS split, ts_ns // {5 * DAY_NS} AS win, sum(gain) AS pnl, max(abs(gain)) AS dd, count(*) AS fills
  FROM p JOIN moves ON fell >= drop AND gain IS NOT NULL GROUP BY 1, 2, 3),
sc AS (SELECT *, pnl - 0.5 * dd - CASE WHEN fills < 5 THEN 2.0 ELSE 0.0 END AS score FROM ev),
best AS (SELECT trial FROM (SELECT trial, median(score) AS m FROM sc WHERE split = 'train' GROUP BY 1) ORDER BY m DESC, trial LIMIT 3)"""


@query(
    "parameter_search",
    "E3 A28 A29 K3",
    f"""WITH {SEARCH}
    SELECT trial, round(median(score) FILTER (WHERE split = 'train'), 6) AS train_median_score, round(median(score) FILTER (WHERE split = 'holdout' AND trial IN (SELECT trial FROM best)), 6) AS holdout_median_score,
           CAST(median(fills) FILTER (WHERE split = 'train') AS DOUBLE) AS train_median_fills FROM sc GROUP BY 1""",
)
def _search(t: Tables):
    from oddsloom.operators.timeline import Timeline, following, previous, scan

    moves = scan(
        t.ticks.select("user_id", "ts_ns", "event_id", "price"), Timeline.of("user_id", ["ts_ns", "event_id"], TICK_CHUNK),
        {"next": following(F.col("price")), "was": previous(F.col("price"))},
    ).select("ts_ns", (F.col("next") - F.col("price")).alias("gain"), (F.col("was") - F.col("price")).alias("fell"))

    def evaluate(params, split):
        part = moves.filter((F.col("ts_ns") < SEARCH_SPLIT) == F.lit(split == "train")).filter("gain IS NOT NULL")
        # Trials differ by one number: each row is laid out over the literal ladder, then kept for the
        # trials asked for.
        ladder = F.array(*[F.struct(F.lit(k).cast("bigint").alias("trial"), F.lit(0.02 * k).alias("drop")) for k in range(1, 9)])
        laid = part.withColumn("x", F.explode(ladder)).select("ts_ns", "gain", "fell", "x.*").filter("fell >= drop")
        hits = laid.join(params.select("trial"), "trial", "left_semi")
        return hits.groupBy("trial", floor_div("ts_ns", 5 * DAY_NS).alias("win")).agg(
            F.sum("gain").alias("pnl"), F.max(F.abs("gain")).alias("max_drawdown"), F.count(F.lit(1)).alias("fills"),
            F.lit(1.0).alias("coverage"), F.lit(False).alias("terminated_early"),
        )

    params = t.spark.range(1, 9).select(F.col("id").alias("trial"), (F.lit(0.02) * F.col("id")).alias("drop"))
    board = sl.parameter_search(params, evaluate, trial="trial", initial_cash=100.0, min_fills=5, top_k=3)
    return board.select(
        "trial", F.round("train_median_score", 6).alias("train_median_score"),
        F.round("holdout_median_score", 6).alias("holdout_median_score"), "train_median_fills",
    )


@query(
    "window_coverage",
    "A30",
    f"""WITH {TICKS}, b AS (SELECT user_id, min(ts_ns) AS s, max(ts_ns) AS e, arg_max(ts_ns, event_id % 50) AS t FROM ticks GROUP BY 1)
    SELECT user_id, CASE WHEN e <= s THEN 1.0 ELSE (least(greatest(t, s), e) - s) / (e - s) END AS coverage FROM
    (SELECT user_id, s, CASE WHEN user_id % 10 = 0 THEN s ELSE e END AS e, t FROM (SELECT user_id, s, e, s + (e - s) // 2 AS t FROM b))""",
)
def _coverage(t: Tables):
    b = t.ticks.groupBy("user_id").agg(F.min("ts_ns").alias("s"), F.max("ts_ns").alias("e"))
    b = b.select(
        "user_id", "s", F.when(F.col("user_id") % 10 == 0, F.col("s")).otherwise(F.col("e")).alias("e"),
        (F.col("s") + floor_div(F.col("e") - F.col("s"), 2)).alias("t"),
    )
    return b.select("user_id", sl.window_coverage(b, start="s", end="e", through="t").alias("coverage"))


@query(
    "replay_validity",
    "A31",
    f"""WITH {TICKS} SELECT user_id, count(*) AS records, max(price) - min(price) AS price_range, count(*) >= 65 AND max(price) - min(price) >= 0.5 AS valid FROM ticks GROUP BY 1""",
)
def _validity(t: Tables):
    return sl.replay_validity(t.ticks, key="user_id", price="price", min_records=65, min_range=0.5)


@query(
    "token_coverage",
    "A32",
    f"""WITH {TICKS},
    b AS (SELECT * FROM ticks WHERE event_type = 'view' AND ts_ns BETWEEN {EPOCH_2024 + 3 * DAY_NS} AND {EPOCH_2024 + 20 * DAY_NS}),
    c AS (SELECT user_id, count(*) AS n, count(DISTINCT ts_ns // {HOUR}) AS h FROM b GROUP BY 1),
    d AS (SELECT user_id, count(*) AS n FROM ticks WHERE side <> 'mint' AND ts_ns BETWEEN {EPOCH_2024 + 3 * DAY_NS} AND {EPOCH_2024 + 20 * DAY_NS} GROUP BY 1),
    u AS (SELECT DISTINCT user_id FROM ticks)
    SELECT u.user_id, coalesce(c.n, 0) AS book_rows, coalesce(d.n, 0) AS trade_rows, 409 - coalesce(c.h, 0) AS gap_hours, coalesce(c.n, 0) > 0 AND coalesce(d.n, 0) > 0 AND coalesce(c.h, 0) = 409 AS eligible
    FROM u LEFT JOIN c ON u.user_id = c.user_id LEFT JOIN d ON u.user_id = d.user_id""",
)
def _token(t: Tables):
    return sl.token_coverage(
        t.ticks.filter("event_type = 'view'"), t.ticks.filter("side <> 'mint'"), t.ticks.select("user_id").distinct(),
        token="user_id", ts="ts_ns", start=EPOCH_2024 + 3 * DAY_NS, end=EPOCH_2024 + 20 * DAY_NS,
    )


JOBS = f"""{TICKS},
cat AS (SELECT user_id AS slug, min(ts_ns) AS s, max(ts_ns) AS e FROM ticks GROUP BY 1),
jobs AS (SELECT slug, unnest(range(greatest(s // {DAY_NS}, 19725), least(e // {DAY_NS}, 19745) + 1)) AS day FROM cat),
seen AS (SELECT user_id AS slug, ts_ns // {DAY_NS} AS day, CASE WHEN count(*) > 2 THEN 'completed' WHEN count(*) = 1 THEN 'empty' ELSE 'failed' END AS status, max(ts_ns) AS checked_at FROM ticks GROUP BY 1, 2)"""


def jobs(t: Tables):
    cat = t.ticks.groupBy(F.col("user_id").alias("slug")).agg(F.min("ts_ns").alias("s"), F.max("ts_ns").alias("e"))
    return sl.catalog_days(cat, start="s", end="e", window_start=19725 * DAY_NS, window_end=19745 * DAY_NS)


@query("catalog_days", "J11 S5", f"WITH {JOBS} SELECT slug, day FROM jobs")
def _days(t: Tables):
    return jobs(t).select("slug", "day")


@query(
    "pruned_jobs",
    "J8",
    f"""WITH {JOBS} SELECT j.slug, j.day FROM jobs j WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.slug = j.slug AND s.day = j.day
      AND (status = 'completed' OR (status = 'empty' AND checked_at > {19746 * DAY_NS} - {12 * DAY_NS})))""",
)
def _pruned(t: Tables):
    seen = t.ticks.groupBy(F.col("user_id").alias("slug"), floor_div("ts_ns", DAY_NS).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.max("ts_ns").alias("checked_at")
    ).withColumn("status", F.when(F.col("n") > 2, "completed").when(F.col("n") == 1, "empty").otherwise("failed"))
    return sl.prune_jobs(
        jobs(t), seen, keys=["slug", "day"], now=F.lit(19746 * DAY_NS), recheck_after_ns=12 * DAY_NS
    ).select("slug", "day")

