"""Compact codes of vectors: one codebook per part of the vector, fitted by active-entry Lloyd rounds.

Components become integers floor(scale * x), so every distance, sum and entry is exact. A vector is cut into equal
consecutive parts; each part position has a codebook, which starts as that part of the vectors with the smallest ids.
A round assigns every part to its nearest entry and replaces each entry by the mean of its parts, rounded down.

Each part keeps its entry and its exact distance from round to round. Where that entry did not move, the distance still
stands and beats every other entry that did not move; only moved entries are compared with it. Where it did move, the
part is scanned against its whole codebook. Equal distances go to the lower index in both cases. If no entry moved, the
remaining rounds would change nothing and are left out.

A round reads the vectors once: the same pass writes the new assignment and one row of sums per task, which Spark adds
up. Only codebooks and their sums (parts x entries x width numbers) meet the driver. Each round is a written table, so
a lost executor repeats tasks of one round; the table of the round before is removed.

Vectors that are null or hold null or non-finite components are left out. So are those whose length is not that of
the vector with the smallest id; a length that the parts do not divide is filled up with zeros. Rows without id are
coded, and start a codebook only where there are fewer entries with id; equal ids start in the order of their vectors. With fewer
vectors than entries, codebooks are that much smaller. Components are held within +-2^62 after scaling; sums of
squares beyond 64 bits are null. Null labels are one label. Other columns are ignored. No rows: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, LongType, StructType

from oddsloom.session import release, settle

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Largest component with which squared distances of a part of 2^10 components still fit in 64 bits.
SMALL = 1 << 25
LARGE = 1 << 62
#: Labels up to which their sums are broadcast.
BROADCAST_LABELS = 1 << 16


@dataclass
class Codebooks:
    """`entries[part, entry]` are integer vectors."""

    entries: np.ndarray
    scale: int

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.ravel()).encode()).hexdigest()


def integers(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): 64-bit integers where all are small, Python's otherwise."""
    scaled = np.floor(flat.astype("f8") * scale)
    if not len(flat) or np.abs(scaled).max() < SMALL:
        return scaled.astype(np.int64)
    return np.array([max(-LARGE, min(LARGE, floor(x * scale))) if abs(x) < 2.0**100 else (LARGE if x > 0 else -LARGE) for x in flat.tolist()], object)


def _cut(flat: np.ndarray, rows: int, width: int, parts: int) -> np.ndarray:
    """rows x parts x components, filled up with zeros."""
    each = -(-width // parts)
    out = np.zeros((rows, parts * each), flat.dtype)
    out[:, :width] = flat.reshape(rows, width)
    return out.reshape(rows, parts, each)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of vectors to entries, exact."""
    if x.dtype == object or entries.dtype == object:
        x, entries = x.astype(object), entries.astype(object)
    step = x[:, None] - entries[None]
    return (step * step).sum(axis=2) if x.shape[1] else np.zeros(step.shape[:2], np.int64)


def assign(
    x: np.ndarray, entries: np.ndarray, moved: np.ndarray, held: np.ndarray | None, at: np.ndarray | None, unknown: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of one part position and its distance, from the assignment before (`held`, `at`) if there is one.

    Where the distance before is `unknown` the codebook is scanned again."""
    if held is None:
        every = distances(x, entries)
        held = every.argmin(axis=1)
        return held, every[np.arange(len(x)), held]
    held, at = held.copy(), at.copy()
    again = moved[held] | unknown
    if again.any():
        every = distances(x[again], entries)
        held[again] = every.argmin(axis=1)
        at[again] = every[np.arange(len(every)), held[again]]
    active, still = np.flatnonzero(moved), np.flatnonzero(~again)
    if len(active) and len(still):
        every = distances(x[still], entries[active])
        best = every.argmin(axis=1)
        near, index = every[np.arange(len(still)), best], active[best]
        better = (near < at[still]) | ((near == at[still]) & (index < held[still]))
        held[still[better]], at[still[better]] = index[better], near[better]
    return held, at


def _exact(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array([int(v) for v in values.ravel()], kind)


def _round(books: Codebooks, moved: np.ndarray, width: int, schema: pa.Schema):
    """The next assignment of each row, and behind a task's rows one row with the number and the sum of each entry's parts."""
    parts, entries, each = books.entries.shape
    wide = pa.decimal128(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, each), object)
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            x = _cut(integers(batch.column("v").flatten().to_numpy(zero_copy_only=False), books.scale), n, width, parts)
            first = batch.column("held").null_count == n
            held = None if first else np.frombuffer(b"".join(batch.column("held").to_pylist()), np.uint16).reshape(n, parts)
            last = None if first else batch.column("at").flatten()
            at = None if first else last.fill_null(0).to_numpy(zero_copy_only=False).reshape(n, parts)
            unknown = None if first else last.is_null().to_numpy(zero_copy_only=False).reshape(n, parts)
            if x.dtype == object and not first:
                at = at.astype(object)
            new, near = np.zeros((n, parts), np.uint16), np.zeros((n, parts), x.dtype if books.entries.dtype != object else object)
            for p in range(parts):
                before = (None, None, None) if first else (held[:, p].astype(np.int64), at[:, p], unknown[:, p])
                new[:, p], near[:, p] = assign(x[:, p], books.entries[p], moved[p], *before)
                counts[p] += np.bincount(new[:, p], minlength=entries)
                order = np.argsort(new[:, p], kind="stable")
                used, starts = np.unique(new[order, p], return_index=True)
                if each:
                    sums[p, used] += np.add.reduceat(x[order, p], starts, axis=0).astype(object)
            kept = [batch.column(k) for k in ("id", "label", "v")]
            far = near.ravel() > np.iinfo(np.int64).max
            long = pa.array(np.where(far, 0, near.ravel()).astype(np.int64), mask=far.astype(bool))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * parts), long)
            blank = [pa.nulls(n, schema.field(k).type) for k in ("counts", "sums")]
            codes = pa.array([row.tobytes() for row in new], pa.binary())
            yield pa.RecordBatch.from_arrays([*kept, codes, lists.cast(schema.field("at").type), *blank], schema=schema)
        told = [pa.ListArray.from_arrays(pa.array([0, a.size], pa.int32()), _exact(a, wide)) for a in (counts, sums)]
        none = [pa.nulls(1, schema.field(k).type) for k in ("id", "label", "v", "held", "at")]
        yield pa.RecordBatch.from_arrays([*none, *[t.cast(schema.field(k).type) for t, k in zip(told, ("counts", "sums"))]], schema=schema)

    return run


def _added(state: DataFrame, name: str) -> dict[int, int]:
    """Sums over the tasks, by place."""
    told = state.filter("counts IS NOT NULL").select(F.posexplode(name).alias("place", "n"))
    return {place: int(n) for place, n in told.groupBy("place").agg(F.sum("n")).collect()}


def _usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf")))
    return vectors.filter(v.isNotNull() & F.forall(v, finite))


def fit_codes(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, Codebooks | None]:
    """(id, label, v, held, at) of the usable vectors after the last round, and the codebooks; None without vectors.

    `held` holds an entry's index per part as unsigned 16-bit integers, `at` the squared distances (null beyond 64 bits)."""
    rows = _usable(vectors, vector_col).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    wide = DecimalType(38, 0)
    schema = StructType([*rows.schema.fields]).add("held", "binary").add("at", ArrayType(LongType())).add("counts", ArrayType(wide)).add("sums", ArrayType(wide))
    state = rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema.fields[3:]})
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(1).collect()
    if not first:
        return state, None
    width = len(first[0]["v"])
    state = state.filter(F.size("v") == width)
    seeds = [r["v"] for r in rows.filter(F.size("v") == width).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    flat = integers(np.array([x for v in seeds for x in v], "f8"), scale)
    books = Codebooks(np.swapaxes(_cut(flat, len(seeds), width, parts), 0, 1).copy(), scale)
    moved = np.ones(books.entries.shape[:2], bool)
    arrow, table = to_arrow_schema(schema), None
    for turn in range(rounds + 1):
        done = settle(state.mapInArrow(_round(books, moved, width, arrow), schema))
        release(*([table] if table else []))
        table, state = done, done.filter("counts IS NULL")
        if turn == rounds:
            break
        counts, sums = _added(done, "counts"), _added(done, "sums")
        each = books.entries.shape[2]
        fresh = books.entries.astype(object)
        for place, n in counts.items():
            if n:
                p, e = divmod(place, fresh.shape[1])
                fresh[p, e] = [sums[place * each + k] // n for k in range(each)]
        fresh = fresh if fresh.size and max(map(abs, fresh.ravel())) >= SMALL else fresh.astype(np.int64)
        moved = (fresh != books.entries).any(axis=2)
        if not moved.any():
            break
        books = Codebooks(fresh, scale)
    return state, books


def decoded(codes: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, v): each vector as its code tells it, in the units of the input; a filled-up vector keeps its zeros."""
    parts = books.entries.shape[0]
    schema = StructType([codes.schema["id"], codes.schema["label"]]).add("v", ArrayType(DoubleType()))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            held = np.frombuffer(b"".join(batch.column("held").to_pylist()), np.uint16).reshape(n, parts)
            v = books.entries[np.arange(parts), held].reshape(n, -1).astype("f8") / books.scale
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), lists.cast(arrow.field("v").type)], schema=arrow)

    return codes.select("id", "label", "held").mapInArrow(run, schema)


def compress(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) per usable vector."""
    state, books = fit_codes(vectors, id_col=id_col, vector_col=vector_col, label_col=label_col, parts=parts, entries=entries, rounds=rounds, scale=scale)
    zero = F.lit(0).cast("decimal(38,0)")
    # Each index is two bytes, the lower one first; an index below 256 is told by the first.
    swapped = F.regexp_replace(F.hex("held"), "(..)(..)", "$2$1" if entries > 256 else "$1")
    coded = state.select("id", "label", F.lower(swapped).alias("code"), F.aggregate("at", zero, lambda acc, x: (acc + x.cast("decimal(19,0)")).cast("decimal(38,0)")).alias("e"))
    sums = coded.groupBy("label").agg(F.sum("e").alias("s")).select(F.col("label").alias("of"), "s")
    few = sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    met = coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("of")))
    long = lambda c: F.expr(f"try_cast({c} AS BIGINT)")
    return met.select(
        F.col("id").alias(id_col), F.col("label").alias(label_col), "code", long("e").alias("error"), long("s").alias("label_error"),
        F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"),
    )
