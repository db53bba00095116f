"""Order-book rows: snapshots and changes to deltas, snapshot diffs, top of book, book measures."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsloom.functions.codes import (
    ACTION_ADD,
    ACTION_CLEAR,
    ACTION_DELETE,
    ACTION_UPDATE,
    FLAG_LAST,
    SIDE_BUY,
    SIDE_NONE,
    SIDE_SELL,
)
from oddsloom.functions.integers import floor_div
from oddsloom.operators.timeline import (
    CUT,
    Timeline,
    find_cuts,
    latest,
    number,
    previous,
    running_count,
    running_max,
    scan,
)

LEVELS = "array<array<string>>"
SNAPSHOT_TYPES = ("book", "book_snapshot")
DELTA = ("event_index", "action", "side", "price", "size", "flags", "sequence", "ts_event", "ts_init")


def event_priority(event_type: Column) -> Column:
    """Snapshots before changes before anything else at one instant."""
    return F.when(event_type.isin(*SNAPSHOT_TYPES), 0).when(event_type == "price_change", 1).otherwise(2)


def payload_to_fixed(df: DataFrame, *, data: str = "data") -> DataFrame:
    """JSON-payload rows in the fixed layout: token, decimal-second time, sides or one change."""
    doc = F.from_json(
        F.col(data),
        "token_id string, timestamp string, bids array<array<string>>, asks array<array<string>>, "
        "change_price string, change_size string, change_side string",
    )
    seconds = F.col("__doc.timestamp").cast("decimal(38,18)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    return df.withColumn("__doc", doc).select(
        *[c for c in df.columns if c != data],
        F.col("__doc.token_id").alias("asset_id"),
        F.bround(seconds, 0).cast("bigint").alias("timestamp_ns"),
        F.col("__doc.bids").alias("bids"),
        F.col("__doc.asks").alias("asks"),
        F.col("__doc.change_price").alias("price"),
        F.col("__doc.change_size").alias("size"),
        F.col("__doc.change_side").alias("side"),
    )


def l2_deltas(
    df: DataFrame,
    *,
    token: str = "asset_id",
    event_ts: str = "timestamp_ns",
    receive_ts: str = "timestamp_received_ns",
    pos: str = "pos",
    start: int,
    end: int,
    width: int,
    after: tuple[int, int] | None = None,
    seeded: bool = False,
) -> DataFrame:
    """Raw book rows to delta rows per token.

    Rows are taken in (receive time, snapshot first, source row) order. A non-empty snapshot emits
    CLEAR and one ADD per level in document order, bids first; a change emits UPDATE, or DELETE at
    size zero, once a snapshot has been seen. Snapshots before `start` only arm the token. `after`
    resumes behind the last accepted (receive time, priority).
    """
    as_levels = lambda c: (
        F.from_json(F.col(c), LEVELS) if dict(df.dtypes)[c] == "string" else F.col(c)
    )
    rows = df.withColumns(
        {
            "__rank": event_priority(F.col("event_type")),
            "__bids": F.coalesce(as_levels("bids"), F.array().cast(LEVELS)),
            "__asks": F.coalesce(as_levels("asks"), F.array().cast(LEVELS)),
        }
    ).filter("__rank < 2")
    if after is not None:
        rows = rows.filter(
            (F.col(receive_ts) > after[0])
            | ((F.col(receive_ts) == after[0]) & (F.col("__rank") >= after[1]))
        )
    cuts = find_cuts(rows, token, receive_ts, width)
    line, rows = cuts.line(token, [receive_ts, "__rank", pos]), cuts.mark(rows)
    full = (F.col("__rank") == 0) & (F.size("__bids") + F.size("__asks") > 0)
    rows = scan(rows.withColumn("__full", full), line, {"__seen": running_max(F.col("__full"))})
    inside = F.col(receive_ts).between(start, end)
    armed = F.lit(True) if seeded else F.col("__seen")
    events = rows.filter(inside & (F.col("__full") | ((F.col("__rank") == 1) & armed)))
    events = number(events, line, "event_index")

    level = lambda side: lambda x: F.struct(
        F.lit(ACTION_ADD).alias("action"),
        F.lit(side).alias("side"),
        x[0].cast("double").alias("price"),
        x[1].cast("double").alias("size"),
    )
    fixed = lambda action, side, price, size: F.struct(
        action.alias("action"), side.alias("side"), price.alias("price"), size.alias("size")
    )
    clear = F.array(fixed(F.lit(ACTION_CLEAR), F.lit(SIDE_NONE), F.lit(0.0), F.lit(0.0)))
    snapshot = F.concat(
        clear, F.transform("__bids", level(SIDE_BUY)), F.transform("__asks", level(SIDE_SELL))
    )
    amount = F.col("size").cast("double")
    side = F.when(F.col("side") == "BUY", SIDE_BUY).when(F.col("side") == "SELL", SIDE_SELL)
    change = F.array(
        fixed(
            F.when(amount > 0, ACTION_UPDATE).otherwise(ACTION_DELETE),
            F.coalesce(side, F.raise_error(F.lit("price_change without a usable side")).cast("int")),
            F.col("price").cast("double"),
            amount,
        )
    )
    parts = F.when(F.col("__full"), snapshot).otherwise(change)
    return events.select(
        token, "event_index", F.col(event_ts).alias("ts_event"), F.col(receive_ts).alias("ts_init"),
        F.size(parts).alias("__n"), F.posexplode(parts).alias("part", "__row"),
    ).select(
        token,
        "event_index",
        "part",
        "__row.*",
        F.when(F.col("part") + 1 == F.col("__n"), FLAG_LAST).otherwise(0).alias("flags"),
        F.lit(0).alias("sequence"),
        "ts_event",
        "ts_init",
    )


def nested_to_flat(df: DataFrame, bids: str = "bids", asks: str = "asks") -> DataFrame:
    """list<struct<price,size>> sides as the parallel text arrays `snapshot_diffs` takes."""
    pick = lambda c, f: F.transform(F.col(c), lambda x: x[f])
    return df.select(
        *[c for c in df.columns if c not in (bids, asks)],
        pick(bids, "price").alias("bid_prices"),
        pick(bids, "size").alias("bid_sizes"),
        pick(asks, "price").alias("ask_prices"),
        pick(asks, "size").alias("ask_sizes"),
    )


def snapshot_diffs(
    df: DataFrame, *, token: str, ts: str = "timestamp_ns", pos: str = "pos", start: int, end: int, width: int
) -> DataFrame:
    """Book snapshots to the deltas between them.

    The first non-empty snapshot inside the window is emitted whole; each later one is compared with
    its predecessor, per side and price text. The predecessor comes along in the scan, so both books
    lie in one row and are compared as arrays; only the levels that changed become rows.
    """
    rows = df.filter(F.col(ts) <= end)
    cuts = find_cuts(rows, token, ts, width)
    line, rows = cuts.line(token, [ts, pos]), cuts.mark(rows)
    rows = rows.withColumns({"__bids": _levels("bid"), "__asks": _levels("ask")})
    rows = rows.withColumn("__filled", (F.col(ts) >= start) & ((F.size("__bids") > 0) | (F.size("__asks") > 0)))
    rows = scan(
        rows,
        line,
        {"__shown": running_count(F.col("__filled")), "__was": previous(F.struct("__bids", "__asks"))},
    )
    rows = rows.filter("__shown >= 1").withColumn("__whole", F.col("__filled") & (F.col("__shown") == 1))
    none = F.array().cast("array<struct<text:string,size_text:string>>")
    was = lambda side: F.when(~F.col("__whole"), F.col(f"__was.{side}")).otherwise(none)
    bids, asks = (_changes(F.col(c), was(c), code) for c, code in (("__bids", SIDE_BUY), ("__asks", SIDE_SELL)))
    # One book's levels: bids ascending, then asks descending.
    rows = rows.withColumn("__changes", F.concat(F.array_sort(bids), F.reverse(F.array_sort(asks)))).filter(F.size("__changes") > 0)
    rows = number(rows.select(token, ts, pos, "__whole", "__changes", *[c for c in rows.columns if c == CUT]), line, "event_index")
    clear = F.struct(
        F.lit(0.0).alias("price"), F.lit("").alias("text"), F.lit(SIDE_NONE).alias("side"), F.lit(0.0).alias("size"), F.lit(0).alias("part")
    )
    placed = F.transform(
        "__changes",
        lambda x, i: F.struct(x["price"].alias("price"), x["text"].alias("text"), x["side"].alias("side"), x["size"].alias("size"), (i + 1).alias("part")),
    )
    out = rows.withColumns(
        {"__last": F.size("__changes"), "l": F.explode(F.when(F.col("__whole"), F.concat(F.array(clear), placed)).otherwise(placed))}
    )
    part, size = F.col("l.part"), F.col("l.size")
    return out.select(
        token, "event_index",
        F.when(part == 0, ACTION_CLEAR).when(F.col("__whole"), ACTION_ADD).when(size > 0, ACTION_UPDATE).otherwise(ACTION_DELETE).alias("action"),
        F.col("l.side").alias("side"), F.col("l.price").alias("price"), size.alias("size"),
        F.when(part == F.col("__last"), FLAG_LAST).otherwise(0).alias("flags"),
        F.when(F.col("__whole"), 0).otherwise(part).cast("int").alias("sequence"),
        F.col(ts).alias("ts_event"),
        F.col(ts).alias("ts_init"),
        part.alias("part"),
    )


def _levels(side: str) -> Column:
    """The levels of a side with a positive size; of two entries of one price text the later counts."""
    both = F.arrays_zip(F.col(f"{side}_prices").alias("text"), F.col(f"{side}_sizes").alias("size_text"))
    some = F.filter(both, lambda x: x["size_text"].cast("double") > 0)
    empty = F.array().cast("array<struct<text:string,size_text:string>>")

    def resolved(levels: Column) -> Column:
        texts = F.transform(levels, lambda x: x["text"])
        later = lambda x, i: ~F.array_contains(F.slice(texts, i + 2, F.size(texts)), x["text"])
        return F.when(F.size(F.array_distinct(texts)) == F.size(texts), levels).otherwise(F.filter(levels, later))

    return F.coalesce(F.element_at(F.transform(F.array(some), resolved), 1), empty)


def _changes(now: Column, was: Column, side: int) -> Column:
    """(price, text, side, size) of the levels that are new or differ, and of those that are gone (size 0)."""
    level = lambda x, size: F.struct(x["text"].cast("double").alias("price"), x["text"].alias("text"), F.lit(side).alias("side"), size.alias("size"))
    texts = F.transform(now, lambda x: x["text"])
    gone = F.filter(F.array_except(was, now), lambda x: ~F.array_contains(texts, x["text"]))
    fresh = F.transform(F.array_except(now, was), lambda x: level(x, x["size_text"].cast("double")))
    return F.concat(fresh, F.transform(gone, lambda x: level(x, F.lit(0.0))))


def top_of_book(
    deltas: DataFrame, *, token: str, events_per_chunk: int = 5_000, keep: Sequence[str] = ("ts_event", "ts_init")
) -> DataFrame:
    """Best bid and ask with sizes after every event; one-sided and crossed books are dropped.

    A book is order-recursive, so each token's events are cut into chunks of `events_per_chunk` and
    replayed chunk by chunk in parallel. What a chunk starts from is found relationally: a level's
    last delta in a chunk seeds the following chunks up to its next delta or the next CLEAR. Seeds
    per chunk are at most the token's price grid.
    """
    size = F.lit(events_per_chunk)
    rows = deltas.withColumns(
        {
            "__c": floor_div("event_index", size),
            "__rev": -F.col("event_index"),
            "__revpart": -F.col("part"),
        }
    )
    backwards = Timeline.of(token, ["__rev", "__revpart"], events_per_chunk)
    ahead = scan(
        rows,
        backwards,
        {"__clear": latest(F.when(F.col("action") == ACTION_CLEAR, F.col("event_index")))},
        inclusive=False,
    )
    ends = (
        ahead.filter(F.col("action") != ACTION_CLEAR)
        .groupBy(token, "side", "price", "__c")
        .agg(
            F.max_by(
                F.struct("size", "action", floor_div("__clear", size).alias("clear_c")),
                F.struct("event_index", "part"),
            ).alias("e")
        )
        .withColumn("__next", F.lead("__c").over(Window.partitionBy(token, "side", "price").orderBy("__c")))
        .filter((F.col("e.action") != ACTION_DELETE) & (F.col("e.size") > 0))
    )
    horizon = rows.groupBy(token).agg(F.max("__c").alias("__last"))
    until = F.least(F.col("__next"), F.col("e.clear_c"), F.col("__last"))
    seeds = (
        ends.join(horizon, token)
        .filter(until > F.col("__c"))
        .select(
            token, "side", "price", F.col("e.size").alias("size"),
            F.explode(F.sequence(F.col("__c") + 1, until)).alias("__c"),
        )
        .withColumns({"action": F.lit(ACTION_ADD), "event_index": F.lit(-1).cast("bigint"), "part": F.lit(0)})
    )
    # Not NULL: a NULL would turn the whole integer column into floats on its way to pandas.
    types = dict(deltas.dtypes)
    seeds = seeds.withColumns({c: F.lit(0).cast(types[c]) for c in keep})
    columns = [token, "__c", "event_index", "part", "action", "side", "price", "size", *keep]
    feed = rows.select(*columns).unionByName(seeds)
    schema = (
        deltas.select(token, F.col("event_index").cast("bigint"), *keep)
        .withColumns({c: F.lit(0.0) for c in ("bid", "ask", "bid_size", "ask_size")})
        .schema
    )

    names = [*keep, "event_index"]

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows arrive sorted by (token, chunk, event, part); an event is closed by the next one's first row."""
        book = {SIDE_BUY: _Levels(), SIDE_SELL: _Levels()}
        chunk, event, out = None, None, []

        def close() -> None:
            bids, asks = book[SIDE_BUY], book[SIDE_SELL]
            if event is not None and event[-1] >= 0 and bids.prices and asks.prices:
                bid, ask = bids.prices[-1], asks.prices[0]
                if bid < ask:
                    out.append((chunk[0], event[-1], *event[:-1], bid, ask, bids.sizes[bid], asks.sizes[ask]))

        for pdf in batches:
            rows = zip(
                zip(pdf[token], pdf["__c"]), zip(*[pdf[c] for c in names]), pdf["action"], pdf["side"], pdf["price"], pdf["size"]
            )
            for place, stamp, action, side, price, amount in rows:
                if place != chunk or stamp[-1] != event[-1]:
                    close()
                    event = stamp
                if place != chunk or action == ACTION_CLEAR:
                    book, chunk = {SIDE_BUY: _Levels(), SIDE_SELL: _Levels()}, place
                if action != ACTION_CLEAR:
                    book[side].put(price, amount)
            yield pd.DataFrame(out, columns=schema.names)
            out.clear()
        close()
        yield pd.DataFrame(out, columns=schema.names)

    return (
        feed.repartition(token, "__c")
        .sortWithinPartitions(token, "__c", "event_index", "part")
        .mapInPandas(replay, schema)
    )


class _Levels:
    """One side of a book: sizes by price, and the prices in order, so that the best one is at an end."""

    __slots__ = ("sizes", "prices")

    def __init__(self):
        self.sizes: dict[float, float] = {}
        self.prices: list[float] = []

    def put(self, price: float, size: float) -> None:
        if size > 0:
            if price not in self.sizes:
                insort(self.prices, price)
            self.sizes[price] = size
        elif self.sizes.pop(price, None) is not None:
            del self.prices[bisect_left(self.prices, price)]


def book_measures(bid: str, ask: str, bid_size: str, ask_size: str) -> dict[str, Column]:
    """Imbalance, microprice distance from the midpoint, and spread in basis points."""
    b, a, bs, az = F.col(bid), F.col(ask), F.col(bid_size), F.col(ask_size)
    total, mid = bs + az, (b + a) / 2
    micro = F.try_divide(a * bs + b * az, total)
    zero = F.lit(0.0)
    absent = F.col(bid).isNull()
    return {
        "book_imbalance": F.when(absent, zero).otherwise(F.try_divide(bs - az, total)),
        "microprice_distance": F.when(absent, zero).otherwise(F.try_divide(micro, mid) - 1),
        "spread_bps": F.when(absent, zero).otherwise(F.try_divide(a - b, mid) * 10_000),
    }
