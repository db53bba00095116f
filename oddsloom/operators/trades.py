"""Trade prints from raw venue rows: tie-broken times, stable ids, sides, rejected rows."""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from oddsloom.functions.codes import (
    AGGRESSOR_BUYER,
    AGGRESSOR_NONE,
    AGGRESSOR_SELLER,
    BUY_WORDS,
    L2_TRADE_ID,
    MISSING_FILL_ID,
    SELL_WORDS,
)
from oddsloom.operators.timeline import PLAIN, Timeline, find_cuts, hot_buckets, number, occurrence
from oddsloom.session import NANOS


def _sequence(value: Column) -> Column:
    return F.format_string("%06d", value)


def _number(text: Column) -> Column:
    return F.try_cast(F.trim(text), "double") if hasattr(F, "try_cast") else F.trim(text).try_cast("double")


def _finite(text: Column, low: float = -math.inf, high: float = math.inf) -> Column:
    """The number in a text, NULL unless it lies between the bounds (NaN never does).

    The text is mentioned once: filters are pushed below the projection, where Spark takes each mention anew.
    """
    return F.get(F.filter(F.array(_number(text)), lambda v: (v > low) & (v < high)), F.lit(0))


def public_trades(
    df: DataFrame,
    *,
    token: str = "asset",
    seconds: str = "timestamp",
    tx: str = "transaction_hash",
    side: str = "side",
    price: str = "price",
    size: str = "size",
    width_s: int,
) -> DataFrame:
    """All rows of each token with tie-broken `ts_event`, `trade_id` and the checks they pass.

    Rows of one second are ordered by (tx, side, price, size) text. Counters advance on every row,
    tradable or not; `tradable` tells which rows become trades and `known_side` which carried a
    usable side, so accepted and rejected tables are filters of one result.
    """
    order = [seconds, tx, side, price, size]
    cuts = find_cuts(df, token, seconds, width_s)
    rows = occurrence(cuts.mark(df), cuts.line(token, order), seconds, "__in_second")
    rows = number(rows, cuts.line([tx, token], order), "__in_tx")
    clean = F.upper(F.trim(F.col(side)))
    return rows.select(
        *df.columns,
        _finite(F.col(price)).alias("price_value"),
        _finite(F.col(size)).alias("size_value"),
        F.when(clean == "BUY", AGGRESSOR_BUYER)
        .when(clean == "SELL", AGGRESSOR_SELLER)
        .otherwise(AGGRESSOR_NONE)
        .alias("aggressor_side"),
        F.concat_ws(
            "-", F.expr(f"right({tx}, 24)"), F.expr(f"right({token}, 4)"), _sequence(F.col("__in_tx"))
        ).alias("trade_id"),
        (F.col(seconds) * NANOS + F.least(F.col("__in_second"), F.lit(NANOS - 1))).alias("ts_event"),
        _finite(F.col(price), 0, 1).isNotNull().alias("tradable"),
        F.coalesce(clean.isin("BUY", "SELL"), F.lit(False)).alias("known_side"),
    )


def accepted_trades(classified: DataFrame) -> DataFrame:
    return classified.filter("tradable")


def rejected_trades(classified: DataFrame, *, token: str, width_ns: int) -> DataFrame:
    """Rows with an unexpected side or an untradable price, with their place in the token's order."""
    placed = number(classified, Timeline.of(token, ["ts_event", "trade_id"], width_ns), "record_index")
    reason = F.array_compact(
        F.array(
            F.when(~F.col("known_side"), F.lit("unexpected_side")),
            F.when(~F.col("tradable"), F.lit("skipped_price")),
        )
    )
    return placed.withColumn("reason", F.explode(reason))


def onchain_fills(
    df: DataFrame,
    *,
    token: str,
    ts: str = "timestamp_ns",
    price: str = "price",
    size: str = "size",
    side: str | None = "side",
    raw_id: str | None = "id",
    pos: str = "pos",
    suffix: Column | None = None,
    start: int,
    end: int,
    width: int,
) -> DataFrame:
    """Fills inside [start, end]; unusable rows are dropped before any counter sees them."""
    p, s = _finite(F.col(price), 0, 1), _finite(F.col(size), 0)
    rows = df.filter(F.col(ts).between(start, end))
    cuts = find_cuts(rows, token, ts, width)
    rows = cuts.mark(rows)
    if raw_id is None:
        rows = number(rows, cuts.line(token, [ts, pos]), "__sorted")
    rows = rows.withColumns({"price_value": p, "size_value": s}).filter("price_value IS NOT NULL AND size_value IS NOT NULL")
    missing = F.concat(F.lit(f"{MISSING_FILL_ID}-"), F.col(ts).cast("string"))
    if raw_id is None:
        ident = F.concat(missing, F.lit("-"), F.col("__sorted").cast("string"))
    else:
        given = F.col(raw_id)
        ident = F.when(given.isNull() | (given == "") | (F.lower(given) == "nan"), missing).otherwise(given)
    rows = cuts.deal(rows.withColumn("__id", ident))
    rows = occurrence(rows, cuts.line(token, [ts, pos]), ts, "__same_ns")
    rows = number(rows, cuts.line([token, "__id"], [ts, pos]), "__same_id")
    word = F.replace(F.lower(F.trim(F.col(side))), F.lit("-"), F.lit("_")) if side else F.lit(None)
    parts = [F.expr("right(__id, 24)")]
    if suffix is not None:
        parts.append(F.when(F.trim(suffix) != "", F.trim(suffix)))
    return rows.select(
        token,
        F.col("price_value").alias("price"),
        F.col("size_value").alias("size"),
        F.when(word.isin(*BUY_WORDS), AGGRESSOR_BUYER)
        .when(word.isin(*SELL_WORDS), AGGRESSOR_SELLER)
        .otherwise(AGGRESSOR_NONE)
        .alias("aggressor_side"),
        F.concat_ws("-", *parts, _sequence(F.col("__same_id"))).alias("trade_id"),
        (F.col(ts) + F.least(F.col("__same_ns"), F.lit(999))).alias("ts_event"),
    )


def last_trade_ticks(
    df: DataFrame,
    *,
    event_ts: str = "timestamp_ns",
    receive_ts: str = "timestamp_received_ns",
    asset: str = "asset_id",
    pos: str = "pos",
    start: int,
    end: int,
) -> DataFrame:
    """Trades from `last_trade_price` rows; the id hashes the transaction, times and source row."""
    side = F.upper(F.trim(F.col("side")))
    key = F.concat_ws(
        ":",
        F.coalesce(F.nullif(F.col("transaction_hash"), F.lit("")), F.lit("missing")),
        F.col(asset),
        F.col(event_ts).cast("string"),
        F.col(receive_ts).cast("string"),
        F.col(pos).cast("string"),
    )
    return (
        df.filter(
            (F.col("event_type") == "last_trade_price")
            & F.col(event_ts).isNotNull()
            & F.col(receive_ts).between(start, end)
        )
        .withColumns({"__p": _finite(F.col("price"), 0, 1), "__s": _finite(F.col("size"), 0)})
        .filter("__p IS NOT NULL AND __s IS NOT NULL")
        .select(
            asset,
            F.col("__p").alias("price"),
            F.col("__s").alias("size"),
            F.when(side == "BUY", AGGRESSOR_BUYER)
            .when(side == "SELL", AGGRESSOR_SELLER)
            .otherwise(AGGRESSOR_NONE)
            .alias("aggressor_side"),
            F.concat(F.lit(L2_TRADE_ID), F.substring(F.sha2(key, 256), 1, 32)).alias("trade_id"),
            F.col(event_ts).alias("ts_event"),
            F.col(receive_ts).alias("ts_init"),
        )
    )


def dollar_price(text: Column) -> Column:
    """Cents or dollars, told apart by the text: '1' is one cent, '1.0' one dollar; NULL if unusable."""
    marked = text.rlike("[.eE]")
    scaled = F.transform(
        F.array(_number(text)), lambda v: F.when((v >= 0) & ((v < 1) | ((v == 1) & marked)), v).otherwise(v / 100)
    )
    return F.get(F.filter(scaled, lambda v: (v >= 0) & (v <= 1)), F.lit(0))


@F.pandas_udf(StringType())
def shake_id(raw: pd.Series) -> pd.Series:
    """18-byte SHAKE-256 digest; Spark has no built-in for it."""
    return raw.map(lambda text: hashlib.shake_256(text.encode()).hexdigest(18), na_action="ignore")


def exchange_trades(
    df: DataFrame,
    *,
    ticker: str = "ticker",
    ts: str = "ts_ns",
    price_dollars: str | None = None,
    price: str = "yes_price",
    size: str = "count",
    taker: str = "taker_side",
    trade_id: str = "trade_id",
    pos: str = "pos",
    width: int,
    fallback_ids: bool = True,
) -> DataFrame:
    """Exchange prints: ties spread inside their second, yes/no taker sides, hashed ids where absent.

    Counters advance on malformed rows too; those rows are then left out.
    """
    # Without a hot ticker one window does; the cuts' sketches would cost more than they save.
    cut = PLAIN if hot_buckets(df, [ticker]) == [] else None
    same = Timeline.of([ticker, ts, price, size, taker], [ts, pos], width, cut=cut)
    rows = occurrence(df, Timeline.of(ticker, [ts, pos], width, cut=cut), ts, "__tie")
    rows = number(rows, same, "__occurrence") if fallback_ids else rows
    room = F.lit(NANOS - 1) - F.pmod(F.col(ts), F.lit(NANOS))
    parsed = dollar_price(F.col(price))
    if price_dollars:
        parsed = F.coalesce(_finite(F.col(price_dollars)), parsed)
    given = F.nullif(F.col(trade_id), F.lit(""))
    if fallback_ids:
        raw = F.concat_ws(
            "|",
            F.col(ticker),
            F.col(ts).cast("string"),
            F.coalesce(F.col(price_dollars) if price_dollars else F.col(price), F.col(price)),
            F.col(size),
            F.coalesce(F.col(taker), F.lit("")),
            F.col("__occurrence").cast("string"),
        )
        given = F.coalesce(given, shake_id(F.when(given.isNull(), raw)))
    return rows.select(
        ticker,
        parsed.alias("price"),
        _finite(F.col(size)).alias("size"),
        F.when(F.col(taker) == "yes", AGGRESSOR_BUYER)
        .when(F.col(taker) == "no", AGGRESSOR_SELLER)
        .otherwise(AGGRESSOR_NONE)
        .alias("aggressor_side"),
        given.alias("trade_id"),
        (F.col(ts) + F.least(F.col("__tie"), room)).alias("ts_event"),
    ).filter("price IS NOT NULL AND size IS NOT NULL")


def candles_to_bars(df: DataFrame, *, end_s: str, ohlc=("open", "high", "low", "close"), volume: str) -> DataFrame:
    """Bars from candles, leaving out candles without trades."""
    keep = [c for c in df.columns if c not in (*ohlc, volume, end_s)]
    return df.dropna(how="any", subset=list(ohlc)).select(
        *keep, *ohlc, F.col(volume).alias("volume"), (F.col(end_s).cast("bigint") * NANOS).alias("ts_event")
    )


def with_availability(
    df: DataFrame, *, source_ts: str, receive_ts: str | None, delay_ns: int = 0, out: str = "available_ts_ns"
) -> DataFrame:
    """When a row could first be known: its source time plus a delay, or its receipt if later."""
    base = F.col(source_ts) + F.lit(delay_ns)
    return df.withColumn(out, F.greatest(base, F.col(receive_ts)) if receive_ts else base)


def replay_order(books: DataFrame, trades: DataFrame, *, key: str, width: int) -> DataFrame:
    """Books and trades of a key on one timeline: (ts_event, book before trade, ts_init, source row)."""
    both = books.select("*", F.lit(0).alias("priority")).unionByName(
        trades.select("*", F.lit(1).alias("priority")), allowMissingColumns=True
    )
    return number(both, Timeline.of(key, ["ts_event", "priority", "ts_init", "pos"], width), "replay_pos")

