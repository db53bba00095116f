"""Ordered scans that do not depend on any key being small.

A plain `Window.partitionBy(key)` puts all rows of one key into one task. Here a key that holds too
many rows has its timeline split into chunks of a fixed width of the leading order column, and is
scanned in two levels:

1. inside (key, chunk), an ordinary window;
2. over one pre-aggregated row per (key, chunk), a prefix that is joined back to the chunk's rows.

All other keys keep one window each. Which keys are hot is found first, by counting rows per hash
bucket of the key: at most HASH_BUCKETS numbers, and the pass reads the key columns only. Rows are
then shuffled once, by (key, chunk). Without hot keys there is no second level at all: the scan is
the plain window, and so are the scans chained to it. Results are the same either way.

A chain of scans asks only once: `find_cuts` reads keys and leading column in one pass, counts each bucket and sketches the
quantiles of its times; hot keys are then cut by width and, inside a width, at those quantiles, so that a burst is several tasks
too. Every scan of the chain takes its timeline from these cuts and runs no job of its own.

`oddsloom.hotRows` in the session sets the rows a bucket may hold before it counts as hot (0 splits
every key, as the tests do). `width=None` asks for the plain window and is meant only for keys whose
row count is bounded by construction (a market's decision grid, one row per day).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from oddsloom.functions.integers import floor_div
from oddsloom.session import settle

CHUNK = "__chunk"
HASH_BUCKETS = 65_536
HOT_ROWS = 2_000_000
#: Rows of a task of a plain window over many keys, and rows from which on tasks are counted by them.
TASK_ROWS = 500_000
MANY_ROWS = 4_000_000
#: Marks the rows of a chain that found no hot key.
PLAIN = "__plain"
#: Chunk column of a chain with cuts, and quantiles of a hot bucket.
CUT = "__cut"
QUANTILES = 255


@dataclass(frozen=True)
class Timeline:
    """Keys, a total order inside a key (leading column numeric), and the chunk width.

    `by` replaces the width with any expression that never decreases along the order, for keys
    whose leading column is text or too coarse (the first characters of a transaction hash).
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    width: int | float | None
    by: Column | None = None
    #: A column that has the chunk of hot keys, or PLAIN if there are none; set by `Cuts.line`.
    cut: str | None = None

    @classmethod
    def of(
        cls, keys: str | Sequence[str], order: str | Sequence[str], width=None, by: Column | None = None, cut: str | None = None
    ) -> Timeline:
        as_tuple = lambda x: (x,) if isinstance(x, str) else tuple(x)
        return cls(as_tuple(keys), as_tuple(order), width, by, cut)

    def chunk(self) -> Column:
        if self.by is not None:
            return self.by
        lead = F.col(self.order[0])
        if isinstance(self.width, float):
            return F.floor(lead / F.lit(self.width))
        return floor_div(lead, self.width)

    def chunk_name(self) -> str:
        """Column that holds the chunk; equal for timelines that cut a key in the same way."""
        if self.cut is not None:
            return self.cut
        cut = "by" if self.by is not None else f"{self.order[0]}_{self.width}"
        return ("__chunk_" + "_".join((*self.keys, cut))).replace(".", "_")

    def rank(self) -> Column:
        return F.struct(*[F.col(c) for c in self.order])

    def window(self, *more: str) -> WindowSpec:
        return Window.partitionBy(*self.keys, *more).orderBy(*self.order)

    def with_order(self, *order: str) -> Timeline:
        return replace(self, order=tuple(order))


@dataclass(frozen=True)
class Scan:
    """One running quantity: how to take it in a chunk, summarise a chunk, and combine the two."""

    local: Callable[[WindowSpec, WindowSpec], Column]
    total: Callable[[Timeline], Column]
    fold: Callable[[Column, WindowSpec], Column]
    merge: Callable[[Column, Column], Column]


def _before(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, -1)


def running_sum(value: Column) -> Scan:
    def merge(here: Column, carried: Column) -> Column:
        both = F.coalesce(here, F.lit(0)) + F.coalesce(carried, F.lit(0))
        return F.when(here.isNotNull() | carried.isNotNull(), both)

    return Scan(
        lambda frame, _: F.sum(value).over(frame),
        lambda _: F.sum(value),
        lambda total, spec: F.sum(total).over(_before(spec)),
        merge,
    )


def running_count(condition: Column | None = None) -> Scan:
    one = F.lit(1).cast("bigint") if condition is None else F.when(condition, 1).otherwise(0).cast("bigint")
    base = running_sum(one)
    return replace(base, merge=lambda h, c: F.coalesce(h, F.lit(0)) + F.coalesce(c, F.lit(0)))


def running_max(value: Column) -> Scan:
    return Scan(
        lambda frame, _: F.max(value).over(frame),
        lambda _: F.max(value),
        lambda total, spec: F.max(total).over(_before(spec)),
        lambda here, carried: F.greatest(here, carried),
    )


def running_min(value: Column) -> Scan:
    return Scan(
        lambda frame, _: F.min(value).over(frame),
        lambda _: F.min(value),
        lambda total, spec: F.min(total).over(_before(spec)),
        lambda here, carried: F.least(here, carried),
    )


def latest(value: Column) -> Scan:
    """Last non-null value so far."""
    return Scan(
        lambda frame, _: F.last(value, ignorenulls=True).over(frame),
        lambda line: F.max_by(value, F.when(value.isNotNull(), line.rank())),
        lambda total, spec: F.last(total, ignorenulls=True).over(_before(spec)),
        lambda here, carried: F.coalesce(here, carried),
    )


def earliest(value: Column) -> Scan:
    """First non-null value so far."""
    return Scan(
        lambda frame, _: F.first(value, ignorenulls=True).over(frame),
        lambda line: F.min_by(value, F.when(value.isNotNull(), line.rank())),
        lambda total, spec: F.first(total, ignorenulls=True).over(_before(spec)),
        lambda here, carried: F.coalesce(carried, here),
    )


def previous(value: Column) -> Scan:
    """The value on the row before, NULLs included."""
    boxed = F.struct(value.alias("v"))
    return Scan(
        lambda _, ordered: F.lag(boxed).over(ordered),
        lambda line: F.max_by(boxed, line.rank()),
        lambda total, spec: F.lag(total).over(spec),
        lambda here, carried: F.coalesce(here, carried)["v"],
    )


def following(value: Column) -> Scan:
    """The value on the row after, NULLs included."""
    boxed = F.struct(value.alias("v"))
    return Scan(
        lambda _, ordered: F.lead(boxed).over(ordered),
        lambda line: F.min_by(boxed, line.rank()),
        lambda total, spec: F.lead(total).over(spec),
        lambda here, carried: F.coalesce(here, carried)["v"],
    )


def before(inner: Scan) -> Scan:
    """The same running quantity, leaving the current row out."""
    return replace(inner, local=lambda _, ordered: inner.local(_before(ordered), ordered))


def _all(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def whole(
    total: Callable[[Timeline], Column],
    combine: Callable[[Column], Column],
    single: Callable[[WindowSpec], Column],
) -> Scan:
    """A whole-key aggregate handed to each row through its chunk, not through a join on the key."""
    return Scan(
        lambda _, ordered: single(_all(ordered)),
        total,
        lambda part, spec: combine(part).over(_all(spec)),
        lambda here, carried: F.coalesce(carried, here),
    )


def whole_max(value: Column) -> Scan:
    return whole(lambda _: F.max(value), F.max, lambda w: F.max(value).over(w))


def whole_min(value: Column) -> Scan:
    return whole(lambda _: F.min(value), F.min, lambda w: F.min(value).over(w))


def whole_sum(value: Column) -> Scan:
    return whole(lambda _: F.sum(value), F.sum, lambda w: F.sum(value).over(w))


def whole_first(value: Column) -> Scan:
    """The key's first non-null value in timeline order."""
    return whole(
        lambda line: F.min_by(value, F.when(value.isNotNull(), line.rank())),
        lambda part: F.first(part, ignorenulls=True),
        lambda w: F.first(value, ignorenulls=True).over(w),
    )


def whole_last(value: Column) -> Scan:
    """The key's last non-null value in timeline order."""
    return whole(
        lambda line: F.max_by(value, F.when(value.isNotNull(), line.rank())),
        lambda part: F.last(part, ignorenulls=True),
        lambda w: F.last(value, ignorenulls=True).over(w),
    )


def hot_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("oddsloom.hotRows", str(HOT_ROWS)))


def hot_buckets(df: DataFrame, keys: Sequence[str]) -> list[int] | None:
    """Hash buckets of the keys with more than `oddsloom.hotRows` rows: at most HASH_BUCKETS numbers. None stands for all."""
    return _counted(df, keys)[0]


def _counted(df: DataFrame, keys: Sequence[str]) -> tuple[list[int] | None, int | None]:
    """The hot buckets, and the number of rows, from one pass."""
    limit = hot_rows(df)
    if limit == 0:
        return None, None
    counts = df.groupBy(_bucket(keys).alias("__bucket")).agg(F.count(F.lit(1)).alias("__n"))
    found = counts.agg(F.collect_list(F.when(F.col("__n") > limit, F.col("__bucket"))).alias("hot"), F.sum("__n").alias("n")).first()
    return found.hot, found.n or 0


def tasks_for(rows: int) -> int:
    """A power of two of tasks of at most TASK_ROWS rows on average, so that scans of about as many rows agree on it."""
    return 1 << max(0, -(-rows // TASK_ROWS) - 1).bit_length()


def dealt(df: DataFrame, rows: int | None, *by: str) -> DataFrame:
    """Many rows in tasks of a bounded number of rows, each key's together: merged partitions are judged by their compressed
    bytes, which says little of the memory of a sort or an aggregate. Fewer rows stay as they are."""
    return df if rows is None or rows <= MANY_ROWS else df.repartition(tasks_for(rows), *by)


@dataclass(frozen=True)
class Cuts:
    """Where the hot keys of a chain of scans are cut. `table` has the quantiles of each hot bucket; None: no key is hot."""

    keys: tuple[str, ...]
    lead: str
    width: int | float
    table: DataFrame | None
    #: Rows that were counted.
    rows: int

    def mark(self, df: DataFrame) -> DataFrame:
        """`df` with the chunk of its rows, null outside hot buckets; rows dropped or added later need no new cuts."""
        if self.table is None:
            return df
        met = df.withColumn("__bucket", _bucket(self.keys)).join(F.broadcast(self.table), "__bucket", "left")
        # Halving steps: how many quantiles lie at or below the time.
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(QUANTILES.bit_length()))])
        below = lambda at, step: (at + step <= F.size("__at")) & (F.element_at("__at", at + step) <= F.col(self.lead))
        nth = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(below(at, step), step).otherwise(0))
        chunk = F.struct(Timeline.of(self.keys, self.lead, self.width).chunk().alias("wide"), nth.alias("nth"))
        return met.withColumn(CUT, F.when(F.col("__at").isNotNull(), chunk)).drop("__bucket", "__at")

    def deal(self, df: DataFrame) -> DataFrame:
        """Marked rows in tasks of a bounded number of them, for chains of narrow rows.

        Without hot keys all scans of the chain run on these tasks; with some, those up to the first that writes its rows.
        """
        return dealt(df, self.rows, *self.keys, *([] if self.table is None else [CUT]))

    def line(self, keys: str | Sequence[str], order: str | Sequence[str]) -> Timeline:
        """A timeline over these cuts; its keys hold those of the cuts, its order starts with the same column."""
        return Timeline.of(keys, order, self.width, cut=PLAIN if self.table is None else CUT)


def find_cuts(df: DataFrame, keys: str | Sequence[str], lead: str, width: int | float) -> Cuts:
    """One pass over keys and leading column; the driver sees at most QUANTILES numbers for each of at most HASH_BUCKETS hot buckets."""
    keys = (keys,) if isinstance(keys, str) else tuple(keys)
    limit = hot_rows(df)
    ranks = ", ".join(f"{k / (QUANTILES + 1)!r}D" for k in range(1, QUANTILES + 1))
    kind = "bigint" if dict(df.dtypes)[lead] in ("bigint", "int", "smallint", "tinyint") else "double"
    found = df.select(_bucket(keys).alias("__bucket"), F.col(lead).cast(kind).alias("__lead")).groupBy("__bucket").agg(
        F.count(F.lit(1)).alias("__n"), F.expr(f"kll_sketch_agg_{kind}(__lead)").alias("__sketch")
    )
    quantiles = F.expr(f"kll_sketch_get_quantile_{kind}(__sketch, array({ranks}))")
    at = F.when(F.col("__n") > limit, F.struct("__bucket", quantiles.alias("__at")))
    told = found.agg(F.collect_list(at).alias("hot"), F.sum("__n").alias("n")).first()
    rows = [(r["__bucket"], sorted(set(r["__at"]))) for r in told.hot]
    table = df.sparkSession.createDataFrame(rows, f"__bucket int, __at array<{kind}>") if rows else None
    return Cuts(keys, lead, width, table, told.n or 0)


def _bucket(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(HASH_BUCKETS)).cast("int")


def scan(
    df: DataFrame, line: Timeline, outs: Mapping[str, Scan], inclusive: bool = True, hold: bool = False
) -> DataFrame:
    """Add the running columns `outs`; `inclusive=False` leaves the current row out of its frame.

    `hold` keeps the chunk column for a following scan on the same timeline, whose rows then are
    already partitioned and sorted as it needs them; the last scan of a chain drops it.
    """
    keys = list(line.keys)
    specs = list(outs.items())
    back = 0 if inclusive else -1
    chunk = line.chunk_name()
    plain = f"{chunk}{PLAIN}"
    kept = [c for c in df.columns if c not in outs and (hold or c not in (chunk, plain))]

    def one_window(columns: Sequence[Column | str], rows: int | None = None) -> DataFrame:
        ordered = line.window()
        frame = ordered.rowsBetween(Window.unboundedPreceding, back)
        return dealt(df, rows, *keys).select(*columns, *[s.merge(s.local(frame, ordered), F.lit(None)).alias(name) for name, s in specs])

    if line.width is None and line.by is None:
        return one_window(kept)
    if line.cut == PLAIN or plain in df.columns:
        return one_window(kept)
    if line.cut is not None and chunk not in kept:
        # The chunk belongs to the chain; its operator drops it at the end.
        kept.append(chunk)
    held = chunk in df.columns and line.by is None
    if held:
        # Hot keys were told before: their rows carry a chunk. Both levels read a written table, not the chain before it twice.
        base = df if line.cut is None else settle(df)
    else:
        hot, rows = _counted(df, keys)
        if hot is not None and not hot:
            return one_window([*kept, F.lit(None).cast("boolean").alias(plain)] if hold else kept, rows)
        base = df.withColumn(chunk, line.chunk() if hot is None else F.when(_bucket(keys).isin(hot), line.chunk()))
    part = base.filter(F.col(chunk).isNotNull())
    if hold and chunk not in kept:
        kept.append(chunk)
    ordered = Window.partitionBy(*keys, chunk).orderBy(*line.order)
    frame = ordered.rowsBetween(Window.unboundedPreceding, back)
    local = base.select("*", *[s.local(frame, ordered).alias(f"__here_{i}") for i, (_, s) in enumerate(specs)])
    totals = part.groupBy(*keys, chunk).agg(*[s.total(line).alias(f"__total_{i}") for i, (_, s) in enumerate(specs)])
    spec = Window.partitionBy(*keys).orderBy(chunk)
    carry = totals.select(
        *keys, chunk, *[s.fold(F.col(f"__total_{i}"), spec).alias(f"__carry_{i}") for i, (_, s) in enumerate(specs)]
    )
    joined = local.join(carry, [*keys, chunk], "left")
    return joined.select(
        *kept,
        *[
            s.merge(F.col(f"__here_{i}"), F.col(f"__carry_{i}")).alias(name)
            for i, (name, s) in enumerate(specs)
        ],
    )


def fitting_width(df: DataFrame, keys: Sequence[str], lead: str, target_rows: int, probe: int) -> int:
    """Chunk width at which the densest `probe`-wide stretch of any key yields about `target_rows` rows."""
    densest = (
        df.groupBy(*keys, floor_div(lead, probe).alias("__s")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    )
    return probe if not densest else max(1, probe * target_rows // int(densest))


def number(df: DataFrame, line: Timeline, out: str = "pos", hold: bool = False) -> DataFrame:
    """Dense 0-based position of each row inside its key."""
    return scan(df, line, {out: running_count()}, inclusive=False, hold=hold)


def occurrence(df: DataFrame, line: Timeline, same: str, out: str) -> DataFrame:
    """0-based position among neighbouring rows with an equal `same` value, on the key's own timeline.

    With `same` leading the order this numbers the rows of one instant without making every instant
    a group of its own. On a timeline of cuts, whose chunks never part rows of one instant, it is the row number less the
    rank of the instant: one window pass.
    """
    if line.cut is not None and same == line.order[0]:
        place = Window.partitionBy(*line.keys, *([] if line.cut == PLAIN else [line.cut]))
        within = F.row_number().over(place.orderBy(*line.order)) - F.rank().over(place.orderBy(same))
        return df.withColumn(out, F.when(F.col(same).isNull(), 0).otherwise(within).cast("bigint"))
    rows = scan(df, line, {"__at": running_count(), "__same": previous(F.struct(same))}, hold=True)
    fresh = F.coalesce(F.col(f"__same.{same}") != F.col(same), F.lit(True))
    rows = scan(rows.withColumn("__new", F.when(fresh, F.col("__at"))), line, {"__start": latest(F.col("__new"))})
    return rows.withColumn(out, F.col("__at") - F.col("__start")).drop("__at", "__same", "__new", "__start")


def row_frames(
    df: DataFrame,
    keys: str | Sequence[str],
    pos: str,
    back: int,
    outs: Mapping[str, Callable[[WindowSpec], Column]],
    rows_per_chunk: int = 100_000,
) -> DataFrame:
    """Frames over at most `back` preceding rows.

    Chunks hold a fixed number of positions, so every task is the same size however hot a key is;
    the last `back` rows of a chunk are also sent to the next one. `pos` comes from `number`.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    size = max(rows_per_chunk, back)
    kept = [c for c in df.columns if c not in outs]
    home = floor_div(pos, size)
    lent = (F.col(pos) % F.lit(size)) >= F.lit(size - back)
    spread = df.withColumn("__home", home).withColumn(
        CHUNK,
        F.explode(
            F.when(lent, F.array(F.col("__home"), F.col("__home") + 1)).otherwise(
                F.array(F.col("__home"))
            )
        ),
    )
    spec = Window.partitionBy(*keys, CHUNK).orderBy(pos)
    return (
        spread.select("*", *[make(spec).alias(name) for name, make in outs.items()])
        .filter(F.col(CHUNK) == F.col("__home"))
        .select(*kept, *outs.keys())
    )


def linear_recurrence(
    df: DataFrame,
    keys: str | Sequence[str],
    pos: str,
    outs: Mapping[str, tuple[str, float]],
    rows_per_chunk: int = 100_000,
) -> DataFrame:
    """For each `out: (x, alpha)`: y[i] = (1-alpha)*y[i-1] + alpha*x[i] with y[0] = x[0], `pos` from 0.

    The recurrence is affine in the value entering a chunk: y = decay^n * y_in + local. Chunks of
    `rows_per_chunk` positions are smoothed independently from zero, the affine maps are composed
    over one row per chunk, and the entering value is added back. The smoothed rows are settled, so
    that Python sees each row once.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    columns = df.columns
    base = df.withColumn(CHUNK, floor_div(pos, rows_per_chunk))
    schema = base.withColumns({f"__local_{o}": F.lit(0.0) for o in outs}).schema

    cut = [*keys, CHUNK]

    def smooth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows arrive sorted by (key, chunk, position); a batch may end inside a chunk."""
        open_chunk, ended = None, {}
        for pdf in batches:
            if pdf.empty:
                continue
            piece = (pdf[cut] != pdf[cut].shift()).any(axis=1).cumsum()
            step = piece.groupby(piece).cumcount()
            goes_on = (piece == 1) & (tuple(pdf[cut].iloc[0]) == open_chunk)
            from_zero = (pdf[CHUNK] > 0) | goes_on
            for out, (value, alpha) in outs.items():
                x = pdf[value].astype("float64")
                y = x.groupby(piece).ewm(alpha=alpha, adjust=False).mean().droplevel(0)
                decay = (1.0 - alpha) ** step
                seed = (1.0 - alpha) * x.groupby(piece).transform("first") * decay
                y = y - seed.where(from_zero, 0.0)
                y = y + (decay * (1.0 - alpha) * ended.get(out, 0.0)).where(goes_on, 0.0)
                pdf[f"__local_{out}"] = y
                ended[out] = float(y.iloc[-1])
            open_chunk = tuple(pdf[cut].iloc[-1])
            yield pdf

    local = settle(
        base.repartition(*cut).sortWithinPartitions(*cut, pos).mapInPandas(smooth, schema)
    )
    ends = local.groupBy(*keys, CHUNK).agg(
        F.count(F.lit(1)).alias("n"), *[F.max_by(f"__local_{o}", pos).alias(f"end_{o}") for o in outs]
    )
    # Only keys of several chunks have anything to hand on.
    several = ends.filter(F.col(CHUNK) > 0).select(*keys).distinct()
    ends = ends.join(several, keys, "left_semi")
    entering = local.select(*keys, CHUNK).withColumns({f"__in_{o}": F.lit(0.0) for o in outs}).schema

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(CHUNK)
        out_rows = pdf[[*keys, CHUNK]].copy()
        for out, (_, alpha) in outs.items():
            carried, y = [], 0.0
            for end, n in zip(pdf[f"end_{out}"], pdf["n"]):
                carried.append(y)
                y = (1.0 - alpha) ** n * y + end
            out_rows[f"__in_{out}"] = carried
        return out_rows

    carry = ends.groupBy(*keys).applyInPandas(compose, entering)
    steps = F.pmod(F.col(pos), F.lit(rows_per_chunk)) + 1
    return local.join(carry, [*keys, CHUNK], "left").select(
        *columns,
        *[
            (
                F.col(f"__local_{o}")
                + F.pow(F.lit(1.0 - alpha), steps) * F.coalesce(f"__in_{o}", F.lit(0.0))
            ).alias(o)
            for o, (_, alpha) in outs.items()
        ],
    )


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, qs: Mapping[str, float], width: float
) -> DataFrame:
    """Exact interpolated quantiles per key without gathering a group.

    Values are counted first; positions come from a chunked running count over the distinct
    values; only the (at most two) neighbours of each quantile reach the last aggregate.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("__n")
    )
    constant = not keys
    if constant:
        counts = counts.withColumn("__all", F.lit(0))
        keys = ["__all"]
    line = Timeline.of(keys, value, float(width))
    placed = scan(
        counts, line, {"__upto": running_sum(F.col("__n")), "__rows": whole_sum(F.col("__n"))}
    ).withColumn("__from", F.col("__upto") - F.col("__n"))
    parts = []
    for name, q in qs.items():
        at = F.lit(float(q)) * (F.col("__rows") - 1)
        low, high = F.floor(at), F.ceil(at)
        inside = lambda p: (F.col("__from") <= p) & (p < F.col("__upto"))
        parts.append(
            (
                F.max(F.when(inside(low), F.col(value))),
                F.max(F.when(inside(high), F.col(value))),
                F.max(at - low),
                name,
            )
        )
    agged = placed.groupBy(*keys).agg(
        *[p[0].alias(f"__lo_{p[3]}") for p in parts],
        *[p[1].alias(f"__hi_{p[3]}") for p in parts],
        *[p[2].alias(f"__fr_{p[3]}") for p in parts],
    )
    picked = agged.select(
        *keys,
        *[
            (
                F.col(f"__lo_{n}")
                + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__fr_{n}")
            ).alias(n)
            for n in qs
        ],
    )
    return picked.drop("__all") if constant else picked
