"""Positions, settlement, equity and report tables over fills and prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsloom.operators import portfolio as pf
from oddsloom.plans.analogs import DAY_NS, FILL_CHUNK, FILL_ORDER, FILLS, TICK_CHUNK, TICKS, Tables
from oddsloom.plans.edge_study import rounded
from oddsloom.plans.registry import query

TIE = ["order_id", "line_no", "market", "account"]
ORDER = FILL_ORDER
SQL_ORDER = "ts_ns, order_id, line_no, market, account"
SETTLE = 883_612_800_000_000_000  # 1998-01-01

# Odd line numbers play fills, even ones quotes of the same market.
BOOKS = f"""{FILLS},
trades AS (SELECT * FROM fills WHERE line_no % 2 = 1),
quotes AS (SELECT * FROM fills WHERE line_no % 2 = 0),
last_quotes AS (SELECT market, ts_ns, arg_max(price, (order_id, line_no, account)) AS price FROM quotes GROUP BY 1, 2),
outcomes AS (SELECT DISTINCT market, CAST(market % 2 AS DOUBLE) AS outcome FROM fills WHERE market % 5 > 0)"""

SIGNED = """CASE WHEN (action = 'buy') = (side = 'yes') THEN quantity ELSE -quantity END"""
CASH = """(CASE WHEN action = 'buy' THEN -(price * quantity) ELSE price * quantity END - commission)"""


def trades(t: Tables):
    return t.fills.filter("line_no % 2 = 1")


def quotes(t: Tables):
    return t.fills.filter("line_no % 2 = 0")


def outcomes(t: Tables):
    return t.fills.filter("market % 5 > 0").select(
        "market", (F.col("market") % 2).cast("double").alias("outcome")
    ).distinct()


@query(
    "settlement_pnl",
    "A9 E2",
    f"""WITH {BOOKS},
    sums AS (
      SELECT market, sum(CASE WHEN action = 'buy' THEN -price * quantity ELSE price * quantity END) AS cash,
             sum(CASE WHEN action = 'buy' THEN quantity ELSE -quantity END) AS open_quantity, sum(commission) AS commissions,
             arg_max(side, ({SQL_ORDER})) AS contract_side
      FROM trades GROUP BY 1)
    SELECT s.market, round(cash, 6) AS cash, open_quantity, round(commissions, 6) AS commissions, contract_side, outcome,
           round(cash + CASE WHEN contract_side = 'yes' THEN outcome ELSE 1 - outcome END * open_quantity - commissions, 6) AS settlement_pnl
    FROM sums s LEFT JOIN outcomes o ON s.market = o.market""",
)
def _settlement(t: Tables):
    return rounded(pf.settlement_pnl(trades(t), outcomes(t), market="market", order=ORDER), 6)


@query(
    "ledger_pnl",
    "A10",
    f"""WITH {BOOKS},
    exact AS (SELECT market, upper(action) AS side, CAST(quantity AS DECIMAL(18,4)) AS q, CAST(round(price, 4) AS DECIMAL(18,10)) AS p FROM trades),
    sums AS (
      SELECT market, sum(CASE WHEN side = 'BUY' THEN -(q * p) ELSE q * p END) AS cash, sum(CASE WHEN side = 'BUY' THEN q ELSE -q END) AS open_q,
             sum(CASE WHEN side = 'BUY' THEN q * p END) AS bought, sum(CASE WHEN side <> 'BUY' THEN q * p END) AS sold, count(*) AS trades
      FROM exact GROUP BY 1)
    SELECT s.market, CAST(cash AS DOUBLE) AS cash_pnl, CAST(open_q AS DOUBLE) AS open_quantity, CAST(bought AS DOUBLE) AS buy_notional,
           CAST(sold AS DOUBLE) AS sell_notional, trades, round(CAST(cash AS DOUBLE) + outcome * CAST(open_q AS DOUBLE), 6) AS settlement_pnl
    FROM sums s LEFT JOIN outcomes o ON s.market = o.market""",
)
def _ledger(t: Tables):
    rows = trades(t).select("market", F.upper("action").alias("side"), "quantity", F.round("price", 4).alias("price"))
    out = pf.ledger_pnl(rows, outcomes(t), market="market", size="quantity", price="price")
    return out.select(
        "market",
        *[F.col(c).cast("double").alias(c) for c in ("cash_pnl", "open_quantity", "buy_notional", "sell_notional")],
        "trades",
        F.round(F.col("settlement_pnl").cast("double"), 6).alias("settlement_pnl"),
    )


@query(
    "ledger_comparison",
    "J14",
    f"""WITH {BOOKS},
    ledger AS (
      SELECT market, count(*) AS ledger_trades,
             sum(CASE WHEN action = 'buy' THEN -price * quantity ELSE price * quantity END) AS cash,
             sum(CASE WHEN action = 'buy' THEN quantity ELSE -quantity END) AS open_q
      FROM trades GROUP BY 1),
    replayed AS (SELECT market, count(*) AS engine_fills, sum(price * quantity) AS pnl FROM quotes GROUP BY 1)
    SELECT r.market, engine_fills, coalesce(ledger_trades, 0) AS ledger_trades, round(cash + outcome * open_q, 6) AS ledger_pnl,
           round(pnl - (cash + outcome * open_q), 6) AS delta
    FROM replayed r LEFT JOIN ledger l ON r.market = l.market LEFT JOIN outcomes o ON r.market = o.market""",
)
def _comparison(t: Tables):
    replayed = quotes(t).groupBy("market").agg(
        F.count(F.lit(1)).alias("engine_fills"), F.sum(F.col("price") * F.col("quantity")).alias("pnl")
    )
    money = F.col("price") * F.col("quantity")
    buy = F.col("action") == "buy"
    ledger = trades(t).groupBy("market").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(buy, -money).otherwise(money)).alias("cash"),
        F.sum(F.when(buy, F.col("quantity")).otherwise(-F.col("quantity"))).alias("open_q"),
    )
    settled = F.col("cash") + F.col("outcome") * F.col("open_q")
    return replayed.join(ledger, "market", "left").join(outcomes(t), "market", "left").select(
        "market", "engine_fills", F.coalesce("n", F.lit(0).cast("bigint")).alias("ledger_trades"),
        F.round(settled, 6).alias("ledger_pnl"), F.round(F.col("pnl") - settled, 6).alias("delta"),
    )


@query(
    "mark_to_market_pnl",
    "A11",
    f"""WITH {BOOKS},
    cut AS (SELECT DISTINCT market, {SETTLE} + market % 365 * {DAY_NS} AS at_ts FROM trades),
    known AS (SELECT f.*, at_ts FROM trades f JOIN cut USING (market) WHERE ts_ns <= at_ts),
    sums AS (
      SELECT market, sum(CASE WHEN action = 'buy' THEN -price * quantity ELSE price * quantity END - commission) AS cash_pnl,
             sum(CASE WHEN action = 'buy' THEN quantity ELSE -quantity END) AS open_quantity, arg_max(price, ({SQL_ORDER})) AS last_fill
      FROM known GROUP BY 1),
    marks AS (
      SELECT market, arg_max(price, ({SQL_ORDER})) FILTER (WHERE ts_ns <= at_ts) AS at_price, arg_min(price, ({SQL_ORDER})) AS first_price
      FROM quotes JOIN cut USING (market) GROUP BY 1),
    marked AS (SELECT s.*, coalesce(at_price, first_price, last_fill) AS mark FROM sums s LEFT JOIN marks m ON s.market = m.market)
    SELECT market, round(cash_pnl, 6) AS cash_pnl, open_quantity, round(mark, 6) AS mark,
           round(cash_pnl + greatest(0, CASE WHEN open_quantity >= 0 THEN open_quantity * mark ELSE abs(open_quantity) * (1 - mark) END), 6) AS marked_pnl
    FROM marked""",
)
def _marked(t: Tables):
    at = trades(t).select("market", (F.lit(SETTLE) + F.col("market") % 365 * DAY_NS).alias("at_ts")).distinct()
    return rounded(
        pf.mark_to_market_pnl(trades(t), quotes(t), at, market="market", order=ORDER, tie=TIE), 6
    )


@query(
    "running_positions",
    "W13",
    f"""WITH {BOOKS}
    SELECT {SQL_ORDER}, sum({SIGNED}) OVER w AS position, round(sum({CASH}) OVER w, 6) AS cash
    FROM trades WINDOW w AS (PARTITION BY market ORDER BY {SQL_ORDER} ROWS UNBOUNDED PRECEDING)""",
)
def _positions(t: Tables):
    out = pf.running_positions(trades(t), market="market", order=ORDER, width=FILL_CHUNK)
    return out.select(*ORDER, "position", F.round("cash", 6).alias("cash"))


# Portfolio = the supplier's hundred-block: a handful of big portfolios.
CURVE = f"""{BOOKS},
folio AS (SELECT *, market % 7 AS folio FROM trades),
folio_quotes AS (SELECT *, market % 7 AS folio FROM last_quotes),
timeline AS (SELECT DISTINCT folio, ts_ns FROM (SELECT folio, ts_ns FROM folio UNION ALL SELECT folio, ts_ns FROM folio_quotes)),
ends AS (
  SELECT f.market, f.folio, coalesce(max(q.last_ts), max(f.ts_ns)) AS end_ts, max(q.last_ts) IS NOT NULL AS quoted,
         arg_min(f.price, (f.ts_ns, f.order_id, f.line_no, f.market, f.account)) AS first_fill
  FROM folio f LEFT JOIN (SELECT market, max(ts_ns) AS last_ts FROM last_quotes GROUP BY 1) q ON f.market = q.market GROUP BY 1, 2),
deltas AS (SELECT market, ts_ns, sum({SIGNED}) AS dq FROM folio GROUP BY 1, 2),
held AS (SELECT market, ts_ns, sum(dq) OVER (PARTITION BY market ORDER BY ts_ns) AS q FROM deltas),
grid AS (SELECT t.folio, t.ts_ns, e.market, e.quoted, e.first_fill FROM timeline t JOIN ends e ON t.folio = e.folio AND t.ts_ns <= e.end_ts),
valued AS (
  SELECT g.folio, g.ts_ns, coalesce(h.q, 0) AS q, CASE WHEN g.quoted THEN coalesce(p.price, 0) ELSE g.first_fill END AS px
  FROM grid g ASOF LEFT JOIN held h ON g.market = h.market AND g.ts_ns >= h.ts_ns
  ASOF LEFT JOIN last_quotes p ON g.market = p.market AND g.ts_ns >= p.ts_ns),
positions AS (
  SELECT folio, ts_ns, sum(greatest(0, CASE WHEN q >= 0 THEN q * px ELSE abs(q) * (1 - px) END)) AS value,
         sum(CASE WHEN abs(q) > 1e-12 THEN 1 ELSE 0 END) AS n
  FROM valued GROUP BY 1, 2),
cash AS (SELECT folio, ts_ns, sum(sum({CASH})) OVER (PARTITION BY folio ORDER BY ts_ns) AS cash FROM folio GROUP BY 1, 2),
curve AS (
  SELECT t.folio, t.ts_ns, 1000000 + coalesce(c.cash, 0) AS cash, coalesce(p.value, 0) AS position_value,
         1000000 + coalesce(c.cash, 0) + coalesce(p.value, 0) AS equity, CAST(coalesce(p.n, 0) AS BIGINT) AS num_positions
  FROM timeline t ASOF LEFT JOIN cash c ON t.folio = c.folio AND t.ts_ns >= c.ts_ns
  LEFT JOIN positions p ON t.folio = p.folio AND t.ts_ns = p.ts_ns)"""


def curve(t: Tables):
    fold = (F.col("market") % 7).alias("folio")
    return pf.equity_curve(
        trades(t).select("*", fold), quotes(t).select("*", fold), portfolio="folio", order=ORDER, tie=TIE,
        initial_cash=1_000_000, width=FILL_CHUNK,
    )


@query(
    "equity_curve",
    "W14 U1",
    f"""WITH {CURVE} SELECT folio, ts_ns, round(cash, 5) AS cash, round(position_value, 5) AS position_value, round(equity, 5) AS equity, num_positions
    FROM curve""",
)
def _curve(t: Tables):
    return rounded(curve(t), 5)


@query(
    "equity_drawdown",
    "W7 A15",
    f"""WITH {CURVE},
    peaks AS (SELECT folio, ts_ns, equity, max(equity) OVER (PARTITION BY folio ORDER BY ts_ns) AS peak FROM curve)
    SELECT folio, round(arg_max(equity, ts_ns), 5) AS final_equity,
           round(max(CASE WHEN peak > 0 THEN (peak - equity) / peak ELSE 0 END), 9) AS max_drawdown,
           round((arg_max(equity, ts_ns) - 1000000) / 1000000, 10) AS total_return
    FROM peaks GROUP BY 1""",
)
def _final(t: Tables):
    out = pf.final_metrics(curve(t), keys=["folio"], order=["ts_ns"], initial=1_000_000, width=FILL_CHUNK)
    return out.select(
        "folio", F.round("final_equity", 5).alias("final_equity"), F.round("max_drawdown", 9).alias("max_drawdown"),
        F.round("total_return", 10).alias("total_return"),
    )


@query(
    "allocation_changes",
    "W16",
    f"""WITH {BOOKS},
    ends AS (
      SELECT f.market, coalesce(max(q.last_ts), max(f.ts_ns)) AS end_ts, max(q.last_ts) IS NOT NULL AS quoted,
             arg_max(f.price, (f.ts_ns, f.order_id, f.line_no, f.market, f.account)) AS last_fill
      FROM trades f LEFT JOIN (SELECT market, max(ts_ns) AS last_ts FROM last_quotes GROUP BY 1) q ON f.market = q.market GROUP BY 1),
    deltas AS (SELECT market, ts_ns, sum({SIGNED}) AS dq FROM trades GROUP BY 1, 2),
    held AS (SELECT market, ts_ns, sum(dq) OVER (PARTITION BY market ORDER BY ts_ns) AS q FROM deltas),
    points AS (SELECT DISTINCT market, ts_ns FROM (SELECT market, ts_ns FROM trades UNION ALL SELECT market, ts_ns FROM last_quotes)
               WHERE market IN (SELECT market FROM trades)),
    valued AS (
      SELECT g.market, g.ts_ns, e.end_ts, coalesce(h.q, 0) AS q, CASE WHEN e.quoted THEN coalesce(p.price, 0) ELSE e.last_fill END AS px
      FROM points g JOIN ends e ON g.market = e.market ASOF LEFT JOIN held h ON g.market = h.market AND g.ts_ns >= h.ts_ns
      ASOF LEFT JOIN last_quotes p ON g.market = p.market AND g.ts_ns >= p.ts_ns),
    held_values AS (
      SELECT market, ts_ns, end_ts, CASE WHEN ts_ns <= end_ts THEN greatest(0, CASE WHEN q >= 0 THEN q * px ELSE abs(q) * (1 - px) END) ELSE 0 END AS value
      FROM valued),
    steps AS (
      SELECT market, ts_ns, value - coalesce(lag(value) OVER (PARTITION BY market ORDER BY ts_ns), 0) AS d FROM held_values WHERE ts_ns <= end_ts
      UNION ALL SELECT market, end_ts + 1, -value FROM held_values WHERE ts_ns = end_ts
      UNION ALL SELECT market, ts_ns, 0 FROM held_values WHERE ts_ns > end_ts
      UNION ALL SELECT market, ts_ns, 0 FROM last_quotes WHERE market NOT IN (SELECT market FROM trades)),
    ranked AS (
      SELECT market FROM (SELECT market, max(value) AS peak FROM held_values GROUP BY 1
                          UNION ALL SELECT DISTINCT market, 0 FROM last_quotes WHERE market NOT IN (SELECT market FROM trades))
      ORDER BY peak DESC, market LIMIT 50),
    labelled AS (
      SELECT coalesce(CAST(r.market AS VARCHAR), 'Other') AS label, ts_ns, sum(d) AS d
      FROM steps s LEFT JOIN ranked r ON s.market = r.market GROUP BY 1, 2)
    SELECT label, ts_ns, round(sum(d) OVER (PARTITION BY label ORDER BY ts_ns), 5) AS value FROM labelled""",
)
def _allocation(t: Tables):
    out = pf.allocation_changes(
        trades(t), quotes(t), market="market", order=ORDER, tie=TIE, width=FILL_CHUNK, top=50
    )
    return rounded(out, 5)


@query(
    "quantity_shares",
    "W17",
    f"""WITH {TICKS},
    moves AS (
      SELECT user_id AS market, ts_ns // {DAY_NS} * {DAY_NS} AS ts_ns, sum(CASE side WHEN 'BUY' THEN size WHEN 'SELL' THEN -size ELSE 0 END) AS d
      FROM ticks GROUP BY 1, 2),
    held AS (SELECT market, ts_ns, sum(d) OVER (PARTITION BY market ORDER BY ts_ns) AS q, coalesce(sum(d) OVER (PARTITION BY market ORDER BY ts_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS was FROM moves),
    ranked AS (SELECT market, row_number() OVER (ORDER BY abs(sum(d)) DESC, market) AS r FROM moves GROUP BY 1),
    steps AS (
      SELECT ts_ns, CASE WHEN r <= 8 THEN r ELSE 9 END AS r, sum(abs(q) - abs(was)) AS step FROM held JOIN ranked USING (market) GROUP BY 1, 2),
    stamps AS (SELECT DISTINCT ts_ns FROM steps),
    totals AS (
      SELECT s.ts_ns, g.r, coalesce(sum(t.step), 0) AS held
      FROM stamps s CROSS JOIN (SELECT unnest(range(1, 10)) AS r) g LEFT JOIN steps t ON t.r = g.r AND t.ts_ns <= s.ts_ns GROUP BY 1, 2),
    gross AS (SELECT ts_ns, sum(held) AS gross FROM totals GROUP BY 1)
    SELECT ts_ns, {", ".join(f"round(coalesce(max(held) FILTER (WHERE r = {i}) / nullif(max(gross), 0), 0), 9) AS share_{i}" for i in range(1, 9))},
           round(coalesce(max(held) FILTER (WHERE r = 9) / nullif(max(gross), 0), 0), 9) AS share_other
    FROM totals JOIN gross USING (ts_ns) GROUP BY 1""",
)
def _shares(t: Tables):
    rows = t.ticks.select(
        F.col("user_id").alias("market"),
        (F.col("ts_ns") - F.pmod(F.col("ts_ns"), F.lit(DAY_NS))).alias("ts_ns"),
        F.when(F.col("side") == "BUY", "buy").when(F.col("side") == "SELL", "sell").alias("action"),
        F.col("size").cast("double").alias("quantity"),
    )
    return rounded(pf.quantity_shares(rows, market="market", ts="ts_ns", order=["ts_ns"], width=TICK_CHUNK * 7), 9)


@query(
    "open_positions",
    "W15",
    f"""WITH {BOOKS},
    moves AS (SELECT market % 7 AS folio, market, ts_ns, sum({SIGNED}) AS dq FROM trades GROUP BY 1, 2, 3),
    held AS (SELECT folio, market, ts_ns, sum(dq) OVER (PARTITION BY market ORDER BY ts_ns) AS q FROM moves),
    steps AS (
      SELECT folio, ts_ns, CASE WHEN abs(q) >= 1e-12 THEN 1 ELSE 0 END
             - CASE WHEN abs(coalesce(lag(q) OVER (PARTITION BY market ORDER BY ts_ns), 0)) >= 1e-12 THEN 1 ELSE 0 END AS o FROM held),
    counts AS (SELECT folio, ts_ns, sum(sum(o)) OVER (PARTITION BY folio ORDER BY ts_ns) AS n FROM steps GROUP BY 1, 2),
    snaps AS (SELECT DISTINCT market % 7 AS folio, ts_ns FROM quotes)
    SELECT s.folio, s.ts_ns, CAST(coalesce(c.n, 0) AS BIGINT) AS open_positions
    FROM snaps s ASOF LEFT JOIN counts c ON s.folio = c.folio AND s.ts_ns >= c.ts_ns""",
)
def _open(t: Tables):
    fold = (F.col("market") % 7).alias("folio")
    snaps = quotes(t).select(fold, "ts_ns").distinct()
    out = pf.open_positions_at(
        trades(t).select("*", fold), snaps, portfolio="folio", market="market", order=ORDER, width=FILL_CHUNK
    )
    return out.withColumn("open_positions", F.col("open_positions").cast("bigint"))


JOINT = """points AS (SELECT market % 7 AS folio, market, ts_ns, arg_max(price, (order_id, line_no, account)) AS v FROM quotes GROUP BY 1, 2, 3),
joint AS (
  SELECT folio, ts_ns, sum(sum(d)) OVER (PARTITION BY folio ORDER BY ts_ns) AS price
  FROM (SELECT folio, ts_ns, v - coalesce(lag(v) OVER (PARTITION BY market ORDER BY ts_ns), 0) AS d FROM points) GROUP BY 1, 2)"""


def joint(t: Tables):
    rows = quotes(t).select("*", (F.col("market") % 7).alias("folio"))
    return pf.joint_series(rows, portfolio="folio", market="market", ts="ts_ns", value="price", tie=TIE, width=FILL_CHUNK)


@query(
    "joint_drawdown",
    "J7 W7",
    f"""WITH {BOOKS}, {JOINT},
    peaks AS (SELECT folio, ts_ns, price, max(price) OVER (PARTITION BY folio ORDER BY ts_ns) AS peak FROM joint)
    SELECT folio, ts_ns, round(price, 6) AS price, round(peak, 6) AS peak, round(peak - price, 6) AS drawdown,
           round((peak - price) / peak, 6) AS drawdown_pct FROM peaks""",
)
def _joint(t: Tables):
    return rounded(
        pf.drawdown(joint(t), keys=["folio"], order=["ts_ns"], value="price", width=FILL_CHUNK), 6
    )


PRICE_SERIES = """points AS (
  SELECT l_suppkey AS market, epoch_us(l_shipdate) * 1000 AS ts_ns, max(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2),
rets AS (SELECT *, price / lag(price) OVER (PARTITION BY market ORDER BY ts_ns) - 1 AS ret FROM points)"""


def price_series(t: Tables):
    from oddsloom.plans.analogs import nanos

    return t.read("lineitem").groupBy(F.col("l_suppkey").alias("market"), nanos("l_shipdate").alias("ts_ns")).agg(
        F.max("l_extendedprice").alias("price")
    )


@query(
    "return_drawdown",
    "W8",
    f"""WITH {PRICE_SERIES},
    cum AS (SELECT market, ts_ns, exp(sum(ln(1 + coalesce(ret, 0))) OVER (PARTITION BY market ORDER BY ts_ns)) AS cumulative FROM rets),
    peaks AS (SELECT *, greatest(1, max(cumulative) OVER (PARTITION BY market ORDER BY ts_ns)) AS peak FROM cum)
    SELECT market, ts_ns, round(cumulative, 6) AS cumulative, round((cumulative - peak) / peak * 100, 6) AS drawdown_pct FROM peaks""",
)
def _return_dd(t: Tables):
    rets = pf.simple_returns(price_series(t), keys=["market"], order=["ts_ns"], value="price", width=FILL_CHUNK)
    rets = rets.withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    out = pf.return_drawdown(rets, keys=["market"], order=["ts_ns"], ret="ret", width=FILL_CHUNK)
    return rounded(out.select("market", "ts_ns", "cumulative", "drawdown_pct"), 6)


@query(
    "return_stats",
    "A13",
    f"""WITH {PRICE_SERIES},
    cum AS (SELECT *, exp(sum(ln(1 + coalesce(ret, 0))) OVER (PARTITION BY market ORDER BY ts_ns)) AS c FROM rets),
    peaks AS (SELECT *, greatest(1, max(c) OVER (PARTITION BY market ORDER BY ts_ns)) AS peak FROM cum)
    SELECT market, round((arg_max(price, ts_ns) / arg_min(price, ts_ns) - 1) * 100, 6) AS total_return_pct,
           round(min((c - peak) / peak * 100), 6) AS max_drawdown_pct,
           round(avg(ret) / stddev_samp(ret) * sqrt(252), 6) AS sharpe,
           round(avg(ret) / sqrt(sum(CASE WHEN ret < 0 THEN ret * ret ELSE 0 END) / count(ret)) * sqrt(252), 6) AS sortino,
           round(sum(CASE WHEN ret > 0 THEN ret END) / sum(CASE WHEN ret < 0 THEN -ret END), 6) AS profit_factor
    FROM peaks GROUP BY 1""",
)
def _stats(t: Tables):
    return rounded(
        pf.return_stats(price_series(t), keys=["market"], order=["ts_ns"], value="price", width=FILL_CHUNK), 6
    )


@query(
    "fill_stats",
    "A12 A14",
    f"""WITH {FILLS}
    SELECT account, count(*) AS fills, round(sum(quantity), 6) AS quantity, round(sum(quantity * price), 5) AS notional,
           round(sum(quantity * price) / sum(quantity), 9) AS average_price
    FROM fills GROUP BY ROLLUP (account)""",
)
def _fill_stats(t: Tables):
    out = pf.fill_stats(t.fills, by=["account"])
    return out.select(
        "account", "fills", F.round("quantity", 6).alias("quantity"), F.round("notional", 5).alias("notional"),
        F.round("average_price", 9).alias("average_price"),
    )


# Returns of a market's monthly table: some months of some parts have no rows.
MONTHS = """points AS (
  SELECT l_partkey AS market, epoch_us(l_shipdate) * 1000 AS ts_ns, max(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2),
rets AS (SELECT *, price / lag(price) OVER (PARTITION BY market ORDER BY ts_ns) - 1 AS ret FROM points),
monthly AS (
  SELECT market, CAST(date_trunc('month', make_timestamp(ts_ns // 1000)) AS DATE) AS month, product(1 + coalesce(ret, 0)) AS g FROM rets GROUP BY 1, 2),
calendar AS (
  SELECT market, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM monthly GROUP BY 1),
filled AS (SELECT c.market, c.month, coalesce(m.g, 1) - 1 AS ret FROM calendar c LEFT JOIN monthly m ON c.market = m.market AND c.month = m.month)"""


def _month(ts: str):
    return F.trunc(F.timestamp_micros((F.col(ts) / 1000).cast("bigint")), "month")


def monthly(t: Tables):
    from oddsloom.plans.analogs import nanos

    points = t.read("lineitem").groupBy(F.col("l_partkey").alias("market"), nanos("l_shipdate").alias("ts_ns")).agg(
        F.max("l_extendedprice").alias("price")
    )
    rets = pf.simple_returns(points, keys=["market"], order=["ts_ns"], value="price", width=FILL_CHUNK)
    return pf.compounded(rets.withColumn("month", _month("ts_ns")), keys=["market"], month="month")


@query(
    "monthly_returns",
    "A16",
    f"""WITH {MONTHS} SELECT market, year(month) * 100 + month(month) AS month, round(ret, 6) AS ret FROM filled""",
)
def _monthly(t: Tables):
    m = F.col("month")
    return monthly(t).select(
        "market", (F.year(m) * 100 + F.month(m)).cast("bigint").alias("month"), F.round("ret", 6).alias("ret")
    )


@query(
    "year_month_table",
    "A16",
    f"""WITH {MONTHS} SELECT market, year(month) AS year,
    {", ".join(f"round(max(ret * 100) FILTER (WHERE month(month) = {i}), 4) AS m{i:02d}" for i in range(1, 13))}
    FROM filled GROUP BY 1, 2""",
)
def _table(t: Tables):
    out = rounded(pf.year_month_table(monthly(t), keys=["market"], month="month"), 4)
    return out.withColumn("year", F.col("year").cast("bigint"))


@query(
    "month_edges",
    "A17",
    f"""WITH {PRICE_SERIES}
    SELECT market, year(make_timestamp(ts_ns // 1000)) * 100 + month(make_timestamp(ts_ns // 1000)) AS month,
           arg_min(price, ts_ns) AS first_value, arg_max(price, ts_ns) AS last_value,
           round((arg_max(price, ts_ns) - arg_min(price, ts_ns)) / arg_min(price, ts_ns), 9) AS ret
    FROM points GROUP BY 1, 2""",
)
def _edges(t: Tables):
    m = F.timestamp_micros((F.col("ts_ns") / 1000).cast("bigint"))
    out = pf.month_edges(
        price_series(t), keys=["market"], month=(F.year(m) * 100 + F.month(m)).cast("bigint"), order=["ts_ns"], value="price"
    )
    return out.withColumn("ret", F.round("ret", 9))


@query(
    "periodic_pnl",
    "A18",
    f"""WITH {PRICE_SERIES},
    placed AS (SELECT market, ts_ns, price, row_number() OVER (PARTITION BY market ORDER BY ts_ns) - 1 AS pos, count(*) OVER (PARTITION BY market) AS n FROM points),
    counts AS (SELECT market, max(n) AS n, greatest(10, least(100, max(n) // 20)) AS bins FROM placed WHERE n >= 4 GROUP BY 1),
    edges AS (
      SELECT market, i, CASE WHEN i = bins THEN n - 1 ELSE CAST(floor(i * ((n - 1) / bins)) AS BIGINT) END AS pos
      FROM (SELECT *, unnest(range(0, bins + 1)) AS i FROM counts))
    SELECT e.market, e.i - 1 AS bin, p0.ts_ns AS start_ts, p.ts_ns AS end_ts, round(p.price - p0.price, 6) AS pnl
    FROM edges e JOIN edges e0 ON e.market = e0.market AND e.i = e0.i + 1
    JOIN placed p ON p.market = e.market AND p.pos = e.pos JOIN placed p0 ON p0.market = e0.market AND p0.pos = e0.pos""",
)
def _periodic(t: Tables):
    out = pf.periodic_pnl(price_series(t), key="market", order=["ts_ns"], value="price", width=FILL_CHUNK)
    return out.withColumn("pnl", F.round("pnl", 6))


@query(
    "returns_histogram",
    "A19",
    f"""WITH {PRICE_SERIES},
    b AS (SELECT *, min(ret) OVER (PARTITION BY market) AS lo, max(ret) OVER (PARTITION BY market) AS hi FROM rets WHERE ret IS NOT NULL),
    s AS (SELECT *, CASE WHEN hi > lo THEN least(CAST(floor((ret - lo) / ((hi - lo) / 50)) AS INTEGER), 49) ELSE 0 END AS bin FROM b)
    SELECT market, bin, count(*) AS n, round(max(lo + bin * ((hi - lo) / 50)), 9) AS lower FROM s GROUP BY 1, 2""",
)
def _histogram(t: Tables):
    rets = pf.simple_returns(price_series(t), keys=["market"], order=["ts_ns"], value="price", width=FILL_CHUNK)
    out = pf.histogram(rets, key="market", order=["ts_ns"], value="ret", bins=50, width=FILL_CHUNK)
    return out.withColumn("lower", F.round("lower", 9))


@query(
    "rolling_sharpe",
    "W9",
    f"""WITH {PRICE_SERIES},
    n AS (SELECT *, count(*) OVER (PARTITION BY market) AS n, row_number() OVER (PARTITION BY market ORDER BY ts_ns) - 1 AS pos,
                 ts_ns - lag(ts_ns) OVER (PARTITION BY market ORDER BY ts_ns) AS gap FROM rets),
    w AS (SELECT *, greatest(20, least(500, n // 20)) AS win, median(gap) OVER (PARTITION BY market) AS med FROM n WHERE n >= 60),
    f AS (
      SELECT a.market, a.ts_ns, a.win, a.pos, a.med, avg(b.ret) AS m, stddev_samp(b.ret) AS s
      FROM w a LEFT JOIN w b ON a.market = b.market AND b.pos BETWEEN a.pos - a.win + 1 AND a.pos GROUP BY ALL)
    SELECT market, ts_ns, win AS window,
           round(CASE WHEN pos >= win THEN m / s * sqrt(greatest(1, {pf.YEAR_S} / (med / 1e9))) END, 5) AS sharpe FROM f""",
)
def _sharpe(t: Tables):
    out = pf.rolling_sharpe(
        price_series(t), key="market", order=["ts_ns"], value="price", width=FILL_CHUNK, median_width=float(DAY_NS)
    )
    return out.withColumn("sharpe", F.round("sharpe", 5))


@query(
    "adjusted_series",
    "W18 W19",
    f"""WITH {BOOKS},
    points AS (SELECT market, ts_ns, arg_max(price, (order_id, line_no, account)) AS v FROM quotes GROUP BY 1, 2),
    settle AS (SELECT DISTINCT market, {SETTLE} + market % 365 * {DAY_NS} AS moment, market % 2 - 0.25 AS d1, market % 2 - 0.5 AS d2 FROM fills WHERE market % 3 = 0),
    firsts AS (SELECT market, arg_min(v, ts_ns) AS first_v FROM points GROUP BY 1),
    stamps AS (SELECT market, ts_ns FROM points UNION SELECT market, moment FROM settle WHERE market IN (SELECT market FROM points)),
    based AS (SELECT s.market, s.ts_ns, coalesce(p.v, f.first_v) AS v FROM stamps s JOIN firsts f ON s.market = f.market
              ASOF LEFT JOIN points p ON s.market = p.market AND s.ts_ns >= p.ts_ns)
    SELECT b.market, b.ts_ns, round(v + CASE WHEN b.ts_ns = moment THEN d1 WHEN b.ts_ns > moment THEN d2 ELSE 0 END, 9) AS price
    FROM based b LEFT JOIN settle s ON b.market = s.market WHERE s.market IS NOT NULL
    UNION ALL SELECT market, ts_ns, round(v, 9) FROM based WHERE market NOT IN (SELECT market FROM settle)""",
)
def _adjusted(t: Tables):
    settle = t.fills.filter("market % 3 = 0").select("market").distinct().select(
        "market",
        (F.lit(SETTLE) + F.col("market") % 365 * DAY_NS).alias("settle_ts"),
        (F.col("market") % 2 - 0.25).cast("double").alias("at_delta"),
        (F.col("market") % 2 - 0.5).cast("double").alias("after_delta"),
    )
    out = pf.adjust_series(quotes(t), settle, market="market", ts="ts_ns", value="price", tie=TIE, width=FILL_CHUNK)
    return out.withColumn("price", F.round("price", 9))


@query(
    "settlement_rule",
    "W19",
    f"""WITH {BOOKS},
    ends AS (SELECT market, CASE WHEN market % 11 = 0 THEN NULL ELSE max(ts_ns) END AS through FROM trades GROUP BY 1),
    r AS (SELECT e.market, through, {SETTLE} + e.market % 365 * {DAY_NS} AS observable, o.outcome FROM ends e LEFT JOIN outcomes o ON e.market = o.market),
    h AS (SELECT market, CASE WHEN through IS NULL THEN 'missing_simulated_through' WHEN through < observable THEN 'resolved_after_replay'
                 WHEN outcome IS NULL THEN 'no_settlement' END AS hold_reason FROM r)
    SELECT market, hold_reason, hold_reason IS NULL AS settlement_applied FROM h""",
)
def _rule(t: Tables):
    ends = trades(t).groupBy("market").agg(F.max("ts_ns").alias("last"))
    rows = ends.join(outcomes(t), "market", "left").select(
        "market",
        F.when(F.col("market") % 11 != 0, F.col("last")).alias("through"),
        (F.lit(SETTLE) + F.col("market") % 365 * DAY_NS).alias("observable"),
        "outcome",
    )
    out = pf.settlement_rule(rows, observable="observable", simulated_through="through", settled="outcome")
    return out.select("market", "hold_reason", "settlement_applied")


@query(
    "fill_bars",
    "J10",
    f"""WITH {BOOKS},
    bars AS (SELECT folio, ts_ns, row_number() OVER (PARTITION BY folio ORDER BY ts_ns) - 1 AS bar FROM (SELECT DISTINCT market % 7 AS folio, ts_ns FROM quotes))
    SELECT f.market, f.ts_ns, f.order_id, f.line_no, f.account, coalesce(b.bar, 0) AS bar
    FROM (SELECT *, market % 7 AS folio FROM trades) f ASOF LEFT JOIN bars b ON f.folio = b.folio AND f.ts_ns >= b.ts_ns""",
)
def _bars(t: Tables):
    fold = (F.col("market") % 7).alias("folio")
    bars = quotes(t).select(fold, "ts_ns").distinct()
    out = pf.place_fills(trades(t).select("*", fold), bars, key="folio", ts="ts_ns", width=FILL_CHUNK)
    return out.select("market", "ts_ns", "order_id", "line_no", "account", "bar")


@query(
    "merged_prices",
    "U2",
    f"""WITH {BOOKS},
    merged AS (SELECT *, 0 AS src FROM quotes UNION ALL SELECT *, 1 FROM trades)
    SELECT market, ts_ns, arg_max(price, (src, order_id, line_no, market, account)) AS price FROM merged GROUP BY 1, 2""",
)
def _merged(t: Tables):
    return pf.merged_prices(quotes(t), trades(t), market="market", ts="ts_ns", tie=TIE)

