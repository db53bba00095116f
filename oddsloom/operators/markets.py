"""Market metadata: decoding, validation, outcome inference, filters and classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.functions.integers import floor_to
from oddsloom.session import NANOS

# Slug prefixes and text patterns that mark games and sports.
GAME_PREFIXES = (
    "cbb-", "cwbb-", "nba-", "wnba-", "nfl-", "cfb-", "mlb-", "nhl-", "soccer-", "tennis-", "golf-", "mma-", "ufc-",
    "boxing-",
)
SPORT_TEXT = (
    r"(?i)\bnba\b|\bwnba\b|\bnfl\b|\bmlb\b|\bnhl\b|\bncaa\b|\bcbb\b|\bsoccer\b|\bfootball\b|"
    r"\btennis\b|\bgolf\b|\bmma\b|\bufc\b|\bboxing\b|\bfifa\b|\bstanley cup\b|\bnba finals\b|"
    r"\bworld cup\b|\bfa cup\b|\bchampions league\b|\bmatch\b|\bgame\b|\bfight\b|\bvs\.?(?=\s)"
)
GAME_TEXT = r"(?i)\bvs\.?\b|\bat\b|@"
NON_GAME_SLUG = (
    r"(?i)-(?:will|to|by|spread|total|ou|over|under|mvp|rookie|qualify|conference|"
    r"championship|playoffs|final-season|score|goals|points|rebounds|assists)-"
)
SETTLED = ("resolved", "settled", "finalized")
TRUE_WORDS = ("1", "true", "yes", "y")
RESOLUTION_FIELDS = (
    "result", "settlement_value", "expiration_value", "closed", "closedTime", "uma_resolution_status",
    "umaResolutionStatus", "is_50_50_outcome", "resolved_by", "resolution_source",
)
TOKEN_RESOLUTION_FIELDS = ("winner",)
RULE_FIELDS = (
    "question", "description", "resolutionSource", "resolution_source", "rules", "marketType", "endDate", "endDateIso",
)
FAMILIES = {"btc_updown_15m": ("btc-updown", 900), "btc_updown_5m": ("btc-updown", 300)}


def _list(c: Column, kind: str = "string") -> Column:
    return F.from_json(c, f"array<{kind}>")


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def price_winners(df: DataFrame, *, outcomes: str, prices: str, closed: Column, status: Column) -> dict[str, Column]:
    """Winner by final price: closed and (if stated) settled markets with a price of at least 0.99.

    `is_tie`: every price is 0.5. `winner_index`: first position of the highest price, or NULL.
    """
    p = F.transform(F.col(prices), lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)))
    any_ = (F.size(F.col(outcomes)) > 0) & (F.size(F.col(prices)) > 0)
    tie = any_ & F.forall(p, lambda x: F.abs(x - 0.5) <= 1e-6)
    settled = F.coalesce(F.trim(status), F.lit("")) == ""
    settled = settled | F.lower(F.trim(status)).isin(*SETTLED)
    top = F.array_max(p)
    won = any_ & ~tie & closed & F.coalesce(settled, F.lit(True)) & (top >= 0.99)
    return {
        "is_tie": F.coalesce(tie, F.lit(False)),
        "winner_index": F.when(won, (F.array_position(p, top) - 1).cast("int")),
    }


def snake_markets(raw: DataFrame) -> DataFrame:
    """camelCase market rows with JSON-text lists to snake_case rows with a token array."""
    lists = raw.withColumns(
        {
            "__ids": F.coalesce(_list(F.col("clobTokenIds")), F.array().cast("array<string>")),
            "__names": F.coalesce(_list(F.col("outcomes")), F.array().cast("array<string>")),
            "__prices": F.coalesce(_list(F.col("outcomePrices")), F.array().cast("array<string>")),
        }
    )
    found = lists.withColumns(
        price_winners(
            lists, outcomes="__names", prices="__prices",
            closed=truthy(F.col("closed")) | F.coalesce(F.col("closedTime") != "", F.lit(False)),
            status=F.col("umaResolutionStatus"),
        )
    )
    n = F.least(F.size("__ids"), F.size("__names"))
    tokens = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(
            F.get(F.col("__ids"), i).alias("token_id"),
            F.get(F.col("__names"), i).alias("outcome"),
            F.coalesce(F.get(F.col("__prices"), i).try_cast("double"), F.lit(0.5)).alias("price"),
            F.coalesce(i == F.col("winner_index"), F.lit(False)).alias("winner"),
        ),
    )
    return found.select(
        F.col("conditionId").alias("condition_id"),
        F.col("question"),
        F.col("slug").alias("market_slug"),
        F.coalesce("orderPriceMinTickSize", F.lit(0.001)).alias("minimum_tick_size"),
        F.coalesce("orderMinSize", F.lit(5.0)).alias("minimum_order_size"),
        truthy(F.col("closed")).alias("closed"),
        F.col("endDateIso").alias("end_date_iso"),
        F.col("is_tie").alias("is_50_50_outcome"),
        F.when(n > 0, tokens).otherwise(F.array().cast("array<struct<token_id:string,outcome:string,price:double,winner:boolean>>")).alias("tokens"),
    )


def canonical_slug(prefix: str, window_s: int, start_s: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-{window_s // 60}m-"), start_s.cast("string"))


def slug_start(slug: Column, prefix: str, window_s: int) -> Column:
    """Window start in seconds from a canonical slug; NULL for any other text or an unaligned start."""
    text = F.regexp_extract(slug, f"^{prefix}-{window_s // 60}m-([0-9]+)$", 1)
    start = F.when(text != "", text).try_cast("bigint")
    return F.when((start % window_s == 0) & (canonical_slug(prefix, window_s, start) == slug), start)


def five_minute_floor(ts_s: Column, window_s: int = 300) -> Column:
    return floor_to(ts_s, window_s)


def rule_hash(fields: list[str] | tuple[str, ...] = RULE_FIELDS, present: list[str] | None = None) -> Column:
    """SHA-256 of the rule fields as JSON with sorted keys and NULLs written out."""
    names = sorted(fields)
    have = set(present if present is not None else fields)
    struct = F.struct(*[(F.col(n).cast("string") if n in have else F.lit(None).cast("string")).alias(n) for n in names])
    return F.sha2(F.to_json(struct, {"ignoreNullFields": "false"}), 256)


def content_id(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def market_windows(raw: DataFrame, *, family: str, rule_epoch: str, present: list[str]) -> DataFrame:
    """Metadata to market windows with an `error` column; valid and rejected tables are its filters."""
    prefix, seconds = FAMILIES[family]
    rows = raw.withColumns(
        {
            "__names": F.transform(_list(F.col("outcomes")), lambda x: F.lower(x)),
            "__ids": _list(F.col("clobTokenIds")),
            "__prices": _list(F.col("outcomePrices")),
            "__t0": slug_start(F.col("slug"), prefix, seconds),
        }
    )
    pick = lambda name: F.get(F.col("__ids"), (F.array_position("__names", name) - 1).cast("int"))
    pair = (F.size("__names") == 2) & (F.size("__ids") == 2)
    up, down = F.when(pair, pick("up")), F.when(pair, pick("down"))
    p = F.transform("__prices", lambda x: x.try_cast("double"))
    top = F.array_max(p)
    winner = F.get(F.col("__names"), (F.array_position(p, top) - 1).cast("int"))
    closed = truthy(F.col("closed"))
    resolution = F.when(
        closed, F.when(top < 1 - 1e-9, "void").when(winner.isin("up", "down"), winner).otherwise("void")
    )
    t1 = (F.col("__t0") + seconds) * NANOS
    late = F.unix_micros(F.col("closedTime").try_cast("timestamp")) * 1000
    error = (
        F.when(F.col("__t0").isNull(), "slug")
        .when(~F.coalesce(pair, F.lit(False)), "two_outcomes_required")
        .when(F.array_position("__names", "up") * F.array_position("__names", "down") == 0, "up_down_required")
        .when(closed & (F.coalesce(F.size(p), F.lit(0)) != 2), "prices_do_not_match_outcomes")
    )
    return rows.select(
        F.col("slug"),
        F.col("conditionId").alias("condition_id"),
        up.alias("up_token_id"),
        down.alias("down_token_id"),
        (F.col("__t0") * NANOS).alias("t0"),
        t1.alias("t1"),
        F.lit(rule_epoch).alias("rule_epoch"),
        rule_hash(present=present).alias("rule_hash"),
        resolution.alias("resolution"),
        F.when(closed, F.greatest(late, t1)).alias("label_available_ts"),
        error.alias("error"),
    )


def split_resolution(df: DataFrame, *, key: str, tokens: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """(what a simulation may see, what only the evaluation may see)."""
    secret = [c for c in df.columns if c in RESOLUTION_FIELDS]
    visible = df.drop(*secret).withColumn(
        tokens, F.transform(tokens, lambda x: x.dropFields(*TOKEN_RESOLUTION_FIELDS))
    )
    hidden = df.select(
        key,
        *secret,
        F.transform(
            tokens, lambda x: F.struct(x["outcome"].alias("outcome"), *[x[f].alias(f) for f in TOKEN_RESOLUTION_FIELDS])
        ).alias(tokens),
    )
    return visible, hidden


def realized_outcome(
    *, result: Column, settlement: Column, expiration: Column, tokens: Column, is_tie: Column, outcome: Column
) -> Column:
    """0/1 for the named outcome: stated result, then settled numbers, then the token's winner flag."""
    name = F.lower(F.trim(outcome))
    said = F.lower(F.trim(result))
    by_result = F.when(
        said.isin("yes", "no") & name.isin("yes", "no"), F.when(said == name, 1.0).otherwise(0.0)
    )
    number = lambda c: (
        F.when(c.try_cast("double").isin(0.0, 1.0), c.try_cast("double")).when(c.try_cast("double") == 100.0, 1.0)
    )
    mine = F.get(F.filter(tokens, lambda x: F.lower(F.trim(x["outcome"])) == name), 0)
    by_token = F.when(name != "", mine["winner"].cast("double"))
    return F.when(~F.coalesce(is_tie, F.lit(False)), F.coalesce(by_result, number(settlement), number(expiration), by_token))


def first_number(*candidates: Column) -> Column:
    """First of the text or numeric candidates that reads as a number."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")).try_cast("double") for c in candidates])



def passing_markets(
    df: DataFrame, *, volume: str, yes_price: str, expiry: str, min_volume: float, price_min: float | None,
    price_max: float | None, min_expiry: Column | None, predicate: Column | None = None,
) -> DataFrame:
    """Volume, price band and expiry filter with an optional further condition."""
    keep = F.coalesce(F.col(volume), F.lit(0.0)) >= min_volume
    if price_min is not None or price_max is not None:
        keep = keep & F.col(yes_price).isNotNull()
    if price_min is not None:
        keep = keep & (F.col(yes_price) >= price_min)
    if price_max is not None:
        keep = keep & (F.col(yes_price) <= price_max)
    if min_expiry is not None:
        keep = keep & (F.col(expiry).isNull() | (F.col(expiry) >= min_expiry))
    if predicate is not None:
        keep = keep & predicate
    return df.filter(keep)


def _prefixed(slug: Column) -> Column:
    return F.lower(slug).rlike("^(" + "|".join(GAME_PREFIXES) + ")")


def is_game(slug: Column, *texts: Column) -> Column:
    text = F.concat_ws(" ", *[F.coalesce(x, F.lit("")) for x in texts])
    s = F.lower(slug)
    return _prefixed(slug) & ~s.rlike(NON_GAME_SLUG) & (text.rlike(GAME_TEXT) | s.rlike(r"\d{4}-\d{2}-\d{2}"))


def is_sport(slug: Column, question: Column) -> Column:
    return _prefixed(slug) | F.concat_ws(" ", F.lower(slug), question).rlike(SPORT_TEXT)


def is_live_sport(slug: Column, question: Column, close_ts: Column, now: Column, max_hours: float) -> Column:
    left = (close_ts - now) / F.lit(3600 * NANOS)
    return F.coalesce((left >= 0) & (left <= max_hours), F.lit(False)) & is_sport(slug, question)


def is_recent_sport(slug: Column, question: Column, close_ts: Column, now: Column, max_days: float) -> Column:
    since = (now - close_ts) / F.lit(86400 * NANOS)
    return F.coalesce((since >= 0) & (since <= max_days), F.lit(False)) & is_sport(slug, question)


def window_bounds(close_ts: Column, game_start: Column, active_hours: float, now: Column) -> dict[str, Column]:
    """Active span of a market: from the later of game start and close - hours, to the close."""
    end = F.coalesce(close_ts, now)
    back = end - F.lit(int(active_hours * 3600) * NANOS) if active_hours > 0 else F.lit(None).cast("bigint")
    start = F.greatest(back, game_start)
    return {"activation_start": F.least(start, F.when(start.isNotNull(), end)), "window_end": end}


def main_markets(events: DataFrame, *, event_slug: str, markets: str) -> DataFrame:
    """Of each event's nested markets, the one whose slug equals the event's."""
    return (
        events.withColumn("m", F.explode(markets))
        .filter(F.lower(F.trim(F.col("m.slug"))) == F.lower(F.trim(F.col(event_slug))))
        .select(*[c for c in events.columns if c != markets], "m.*")
    )


def entry_rejection(
    *, data_gap: Column, structure_valid: Column, tick_unchanged: Column, fee_unchanged: Column, latency_healthy: Column,
    age_s: Column, stale_after_s: float,
) -> Column:
    """First reason a signal may not enter; NULL when it may."""
    return (
        F.when(data_gap, "data_gap")
        .when(~structure_valid, "structure_invalid")
        .when(~tick_unchanged, "tick_changed")
        .when(~fee_unchanged, "fee_changed")
        .when(~latency_healthy, "latency_unhealthy")
        .when(age_s > stale_after_s, "data_stale")
    )


def clean_probabilities(df: DataFrame, *, keys: list[str], ts: str, tie: list[str], value: str) -> DataFrame:
    """Last value per instant, clipped to [0, 1], with a mark on what had to be clipped."""
    last = df.filter(F.col(value).isNotNull()).groupBy(*keys, ts).agg(F.max_by(value, F.struct(*tie)).alias("__v"))
    return last.select(
        *keys, ts, F.least(F.lit(1.0), F.greatest(F.lit(0.0), "__v")).alias(value),
        ((F.col("__v") < 0) | (F.col("__v") > 1)).alias("was_invalid"),
    )
