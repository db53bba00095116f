"""Repeated passages by merged Burrows-Wheeler transforms of shards.

A window is a string of `WINDOW` bytes within one text; every byte of a window that also starts anywhere else is
removed. The transform of a shard of strings is kept in columns: column t holds, for the windows in the order of
their last 4 t bytes, the four bytes before those. Shards are merged without touching their texts again: the
interleave Z says which shard each place of the merged order comes from, and one refinement reads the next symbol
of each shard in the order Z, and stably deals Z out by it. After t refinements Z orders all windows by their last
4 t bytes; a place opens a block where its symbol or its old block differs from the place before, which is where
the common string of two neighbours falls short. Blocks of the full window length are the repeated intervals.

What must meet is put together by content, so that no shard is larger than a task. A window's anchor is its least
gram of `GRAM` bytes by hash (the leftmost, in ties), so equal windows have equal anchors at equal distances.
Neighbouring windows with one anchor are a run. An anchor that occurs once has no repeats. Runs of an anchor that
are equal throughout are one string with its count; where that is all an anchor has, all its windows repeat. The
strings of all other anchors are merged. An anchor with very many different strings (the edge of a passage that
countless texts share) is split by the distance of the window to the anchor and by the bytes that all windows at
those distances share; split to single windows, equal strings are one row, so every group gets small in the end.

Nulls: a null text is empty; ids may be null. Repeated rows repeat each other's windows. Texts below the window
length keep everything. Other columns are ignored. No rows: no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from oddsloom.llm.common import bitmap, in_bitmap, screened, unscreened
from oddsloom.llm.words import mix64, span_hashes, text_slices
from oddsloom.session import settle

WINDOW = 200
GRAM = 73
STEP = 4
#: Bytes of strings in a merge, and in one shard of it.
MERGE_BYTES, SHARD_BYTES = 1 << 20, 1 << 18
#: Different strings of an anchor beyond which it is split.
CROWD = 2_000
#: Distances that stay together (as powers of two) when an anchor is split once, twice.
SPLITS = (4, 0)
#: Bits of the anchor screen: 16 MB, whatever the number of anchors.
SCREEN_BITS = 1 << 27
SLICE_BYTES = 1 << 19

_ANCHOR = StructType().add("g", "long")
_RUN = StructType().add("id", "long").add("h", "long").add("p", "integer").add("q", "integer").add("off", "integer").add("g", "long").add("s", "long")
_CUT = StructType().add("g", "long").add("s", "long").add("m", "long").add("off", "integer").add("n", "integer").add("body", "binary")
_KEPT = StructType().add("id", "long").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string").add("kept", "binary")
_PRIME = 0x9E3779B97F4A7C15


# --- anchors -------------------------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-grams, from grams of doubling length."""
    n, length, out, done = len(data), 1, None, 0
    h = mix64(data.astype(np.uint64) + np.uint64(1))
    join = lambda a, b, m, width: a[:m] * np.uint64(pow(_PRIME, width, 1 << 64)) + b[:m]
    while True:
        if k & length:
            out = h if out is None else join(out, h[done:], n - done - length + 1, length)
            done += length
        if 2 * length > k:
            return mix64(out)
        h = join(h, h[length:], len(h) - length, length)
        length *= 2


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    length = 1
    while 2 * length <= width:
        v = np.minimum(v[:-length], v[length:])
        length *= 2
    return np.minimum(v[: len(v) - (width - length)], v[width - length :]) if width > length else v


def anchored_runs(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Of each run of windows with one anchor: text, first window, last window, anchor (positions in `data`), gram hash."""
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return none, none, none, none, none.view(np.uint64)
    hashes = gram_hashes(data, gram)
    ranked = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (sliding_min(ranked, window - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # Windows that end in another text than they start in are none.
    step = np.zeros(len(anchor) + 1, np.int32)
    lengths = np.diff(offsets)
    whole = lengths >= window
    np.add.at(step, offsets[:-1][whole], 1)
    np.add.at(step, offsets[1:][whole] - window + 1, -1)
    valid = np.cumsum(step[:-1]) > 0
    opens = valid.copy()
    opens[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    firsts = offsets[:-1][whole]
    opens[firsts] = True
    p = np.flatnonzero(opens)
    closes = valid.copy()
    closes[:-1] &= ~valid[1:] | opens[1:]
    q = np.flatnonzero(closes)
    return np.searchsorted(offsets, p, "right") - 1, p, q, anchor[p], hashes[anchor[p]]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, offsets in text_slices(batch.column("text"), SLICE_BYTES):
            g = anchored_runs(data, offsets)[4]
            if len(g):
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64))], names=["g"])


def _runs(screen, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(screen.value, np.uint8)
        for batch in batches:
            for row, data, offsets in text_slices(batch.column("text"), SLICE_BYTES):
                text, p, q, a, g = anchored_runs(data, offsets)
                may = in_bitmap(g, bits)
                if not may.any():
                    continue
                text, p, q, a, g = (x[may] for x in (text, p, q, a, g))
                s = span_hashes(data, p, q + WINDOW)
                base, take = offsets[text], pa.array(row + text)
                small = [pa.array(x.astype(np.int32)) for x in (p - base, q - base, a - p)]
                big = [pa.array(x.view(np.int64)) for x in (g, s)]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("h").take(take), *small, *big], schema=schema)

    return run


def _cut(schema: pa.Schema):
    """The bytes of the wanted runs of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                raw = text.encode()
                cols = [[r[k] for r in runs] for k in ("g", "s", "m", "off")]
                counts = [r["q"] - r["p"] + 1 for r in runs]
                bodies = [raw[r["p"] : r["q"] + WINDOW] for r in runs]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*cols, counts, bodies], schema)], schema=schema)

    return run


# --- transforms ----------------------------------------------------------------------------------------------


def _dealt(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols in order, and the stable order itself."""
    key = np.sort((symbol.astype(np.uint64) << np.uint64(32)) | np.arange(len(symbol), dtype=np.uint64))
    return key >> np.uint64(32), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Shard:
    """The transform of some strings: window starts in final order, and a column of symbols per refinement."""

    def __init__(self, strings: list[bytes], windows: np.ndarray, width: int = WINDOW):
        data = np.frombuffer(b"".join(strings) + bytes(STEP), np.uint8).astype(np.uint32)
        word = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
        length = np.array([len(s) for s in strings])
        at = np.repeat(np.cumsum(length) - length, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        self.order, self.columns = np.arange(len(at)), []
        for t in range(width // STEP):
            self.columns.append(word[at[self.order] + width - STEP * (t + 1)])
            self.order = self.order[_dealt(self.columns[-1])[1]]


def merged_blocks(shards: list[Shard]) -> tuple[np.ndarray, np.ndarray]:
    """Windows (numbered shard by shard) in merged order, and whether each place opens a block of equal windows."""
    sizes = [len(s.order) for s in shards]
    z = np.repeat(np.arange(len(shards), dtype=np.uint16), sizes)
    block = np.zeros(len(z), np.int64)
    for columns in zip(*(s.columns for s in shards), strict=True):
        symbol = np.empty(len(z), np.uint32)
        symbol[np.argsort(z, kind="stable")] = np.concatenate(columns)
        dealt, turn = _dealt(symbol)
        z, old = z[turn], block[turn]
        opens = np.ones(len(z), bool)
        opens[1:] = (dealt[1:] != dealt[:-1]) | (old[1:] != old[:-1])
        block = np.cumsum(opens)
    base = np.cumsum([0, *sizes[:-1]])
    window = np.empty(len(z), np.int64)
    window[np.argsort(z, kind="stable")] = np.concatenate([b + s.order for b, s in zip(base, shards)])
    return window, opens


def repeated_windows(strings: list[bytes], windows: np.ndarray, copies: np.ndarray, shard_bytes: int = SHARD_BYTES) -> np.ndarray:
    """Whether each window of each string occurs twice or more, a string counting `copies` times."""
    cuts = np.cumsum([len(s) for s in strings]) // shard_bytes
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(cuts)) + 1, [len(strings)]])
    shards = [Shard(strings[a:b], windows[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    window, opens = merged_blocks(shards)
    first = np.flatnonzero(opens)
    total = np.add.reduceat(np.repeat(copies, windows)[window], first)
    out = np.empty(len(window), bool)
    out[window] = np.repeat(total >= 2, np.diff(np.append(first, len(window))))
    return out


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    windows, copies = group["n"].to_numpy(np.int64), group["m"].to_numpy(np.int64)
    hit = repeated_windows(list(group["body"]), windows, copies)
    start = np.cumsum(windows) - windows
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    # A stretch of repeats ends with its string.
    begins, ends = hit.copy(), hit.copy()
    inner = np.ones(len(hit), bool)
    inner[start] = False
    begins &= ~inner | (edge[:-1] == 1)
    last = np.zeros(len(hit), bool)
    last[start + windows - 1] = True
    ends &= last | (edge[1:] == -1)
    a, b = np.flatnonzero(begins), np.flatnonzero(ends)
    owner = np.searchsorted(start, a, "right") - 1
    return pd.DataFrame({"g": group["g"].to_numpy()[owner], "s": group["s"].to_numpy()[owner], "a": a - start[owner], "b": b - start[owner]})


# --- the job -------------------------------------------------------------------------------------------------


def repeats(strings: DataFrame, splits: tuple[int, ...] = SPLITS, crowd: int = CROWD) -> DataFrame:
    """(g, s, a, b): stretches of repeated windows of the strings (g, s, m, off, n, body)."""
    sizes = settle(strings.groupBy("g").agg(F.count(F.lit(1)).alias("strings"), F.sum("m").alias("all"), F.sum(F.octet_length("body")).alias("bytes")))
    fits = F.col("strings") <= crowd if splits else F.lit(True)
    total = sizes.filter(fits & (F.col("all") > 1)).agg(F.sum("bytes"), F.count_if(~fits)).first()
    groups = max(1, math.ceil((total[0] or 0) / MERGE_BYTES))
    small = strings.join(sizes.filter(fits & (F.col("all") > 1)).select("g"), "g").withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(groups)))
    found = small.groupBy("bucket").applyInPandas(_merge, "g long, s long, a int, b int")
    if not splits or not sizes.filter(~fits).limit(1).count():
        return found
    # Windows at distances c 2^L to (c + 1) 2^L - 1 from the anchor share the bytes of all of them.
    width = 1 << splits[0]
    big = strings.join(sizes.filter(~fits).select("g"), "g")
    low = F.col("off") - F.col("n") + 1
    part = big.withColumn("c", F.explode(F.sequence(F.floor(low / width).cast("int"), F.floor(F.col("off") / width).cast("int"))))
    part = part.withColumns({"near": F.greatest(low, F.col("c") * width), "far": F.least(F.col("off"), (F.col("c") + 1) * width - 1)})
    shift = F.col("off") - F.col("far")
    common = F.substring("body", F.col("off") - F.col("c") * width + 1, F.lit(WINDOW - width + 1))
    part = settle(part.select(
        F.col("g").alias("pg"), F.col("s").alias("ps"), shift.alias("shift"), F.xxhash64("g", "c", common).alias("g"), "m", F.col("far").alias("off"),
        (F.col("far") - F.col("near") + 1).alias("n"), F.substring("body", shift + 1, F.col("far") - F.col("near") + WINDOW).alias("body"),
    ).withColumn("s", F.xxhash64("body")))
    once = settle(part.groupBy("g", "s").agg(F.sum("m").alias("m"), *(F.first(c).alias(c) for c in ("off", "n", "body"))))
    inner = repeats(once, splits[1:], crowd).join(part.select("g", "s", "pg", "ps", "shift"), ["g", "s"])
    return found.union(inner.select("pg", "ps", F.col("a") + F.col("shift"), F.col("b") + F.col("shift")))


def _kept(schema: pa.Schema, keep_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for id_, text, spans in zip(*(batch.column(k).to_pylist() for k in ("id", "text", "spans")), strict=True):
                raw, out, at, removed, count = (text or "").encode(), [], 0, 0, 0
                end = -1
                for a, b in sorted((s["a"], s["b"] + WINDOW) for s in spans or ()):
                    if a > end:
                        count += 1
                        out.append(raw[max(at, 0) : a])
                        removed += b - a
                    else:
                        removed += max(0, b - end)
                    end = at = max(end, b)
                out.append(raw[at:])
                kept = b"".join(out)
                rows.append((id_, len(raw), removed, count, hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) per row of `docs`; `kept` has the remaining bytes."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    often = texts.select("text").mapInArrow(_anchors, _ANCHOR).groupBy("g").count().filter("count > 1")
    screen = spark.sparkContext.broadcast(bitmap(settle(often.select("g")), "g", SCREEN_BITS))
    runs = settle(texts.mapInArrow(_runs(screen, to_arrow_schema(_RUN)), _RUN))
    kinds = settle(runs.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).filter("n > 1"))
    mixed = kinds.filter("lo <> hi").select("g")
    ends = runs.join(mixed, "g").groupBy("g", "s").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("id", "h", "p", "q", "off")).alias("at"))
    wanted = settle(ends.groupBy("at.id", "at.h").agg(
        F.collect_list(F.struct("g", "s", "m", F.col("at.p").alias("p"), F.col("at.q").alias("q"), F.col("at.off").alias("off"))).alias("runs")
    ).select(F.col("id").alias("w_id"), F.col("h").alias("w_h"), "runs"))
    whole = screened(texts, F.col("h"), wanted, "w_h").join(wanted, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("h") == F.col("w_h")))
    strings = settle(whole.select("text", "runs").mapInArrow(_cut(to_arrow_schema(_CUT)), _CUT))
    found = settle(repeats(strings))
    same = runs.join(kinds.filter("lo = hi").select("g"), "g").select("id", "h", F.col("p").alias("a"), F.col("q").alias("b"))
    some = runs.join(found, ["g", "s"]).select("id", "h", (F.col("p") + F.col("a")).alias("a"), (F.col("p") + F.col("b")).alias("b"))
    spans = settle(same.union(some).groupBy("id", "h").agg(F.collect_list(F.struct("a", "b")).alias("spans")).select(
        F.col("id").alias("s_id"), F.col("h").alias("s_h"), "spans"))
    hit = screened(texts, F.col("h"), spans, "s_h").join(spans, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("h") == F.col("s_h")), "left")
    clean = unscreened(texts, F.col("h"), spans, "s_h")
    done = hit.select("id", "text", "spans").mapInArrow(_kept(to_arrow_schema(_KEPT), keep_bytes), _KEPT)
    none = F.lit(0).cast("bigint")
    left = clean.select("id", F.octet_length("text").cast("bigint"), none, none, F.sha2("text", 256), F.encode("text", "UTF-8") if keep_bytes else F.lit(None).cast("binary"))
    return done.union(left).withColumnRenamed("id", id_col)
