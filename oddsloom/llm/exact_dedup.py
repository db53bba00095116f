"""Exact dedup of an incoming batch against an immutable snapshot, screened by static binary-fuse filters.

Each shard of the snapshot's digests has one filter of about nine bits a digest, built once. Digests of the
batch that their filter rejects are certainly new and never meet the snapshot. The others join the exact
digests; where a digest matches, the normalised texts of both representatives are compared byte by byte.
Copies within the batch are grouped on their own.

Nulls: a null text counts as empty; a null id sorts after all others. Repeated rows (equal id and text):
one stays. Other columns are ignored, whatever their names. Empty input gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.llm.common import normalised, screened
from oddsloom.session import settle

#: Digests a filter holds; a shard is one task's work.
SHARD_KEYS = 1 << 15


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) over the seeded keys."""
    x = keys + np.uint64(seed)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class FuseFilter:
    """A static 3-wise binary-fuse filter with 8-bit fingerprints over distinct 64-bit keys."""

    def __init__(self, seed: int, segment: int, spread: int, cells: np.ndarray):
        self.seed, self.segment, self.spread, self.cells = seed, segment, spread, cells

    @staticmethod
    def _slots(h: np.ndarray, segment: int, spread: int) -> np.ndarray:
        """Three cells in neighbouring segments; `spread` is the number of possible first cells."""
        mask = np.uint64(segment - 1)
        first = ((h >> np.uint64(32)) * np.uint64(spread)) >> np.uint64(32)
        second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
        third = (first + np.uint64(2 * segment)) ^ (h & mask)
        return np.stack([first, second, third]).astype(np.int64)

    @staticmethod
    def _prints(h: np.ndarray) -> np.ndarray:
        return (h ^ (h >> np.uint64(32))).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """Peel cells that a single key covers, all of a round at once, then assign in reverse."""
        n = max(len(keys), 2)
        segment = 1 << max(2, min(18, int(math.floor(math.log(n) / math.log(3.33) + 2.25))))
        size = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
        segments = max(1, math.ceil(size / segment) - 2)
        spread, total = segments * segment, (segments + 2) * segment
        for seed in range(1, 1 << 16):
            h = _mix(keys, seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            slots = cls._slots(h, segment, spread)
            count = np.bincount(slots.ravel(), minlength=total)
            holder = np.zeros(total, np.int64)
            for row in slots:
                np.bitwise_xor.at(holder, row, np.arange(len(keys)))
            rounds, left, front = [], len(keys), np.flatnonzero(count == 1)
            while len(front):
                taken, at = np.unique(holder[front], return_index=True)
                rounds.append((taken, front[at]))
                left -= len(taken)
                for row in slots[:, taken]:
                    np.subtract.at(count, row, 1)
                    np.bitwise_xor.at(holder, row, taken)
                touched = np.unique(slots[:, taken])
                front = touched[count[touched] == 1]
            if left == 0:
                cells, prints = np.zeros(total, np.uint8), cls._prints(h)
                for taken, at in reversed(rounds):
                    a, b, c = slots[:, taken]
                    cells[at] = 0
                    cells[at] = prints[taken] ^ cells[a] ^ cells[b] ^ cells[c]
                return cls(seed, segment, spread, cells)
        raise ValueError("keys are not distinct")

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """False only for keys that are certainly absent."""
        h = _mix(keys, self.seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        a, b, c = self._slots(h, self.segment, self.spread)
        return (self._prints(h) ^ self.cells[a] ^ self.cells[b] ^ self.cells[c]) == 0


_FILTER = "shard int, seed long, segment long, spread long, cells binary"


def _build(group: pd.DataFrame) -> pd.DataFrame:
    keys = np.unique(group["key"].to_numpy(np.int64).view(np.uint64))
    f = FuseFilter.build(keys)
    return pd.DataFrame(
        [[int(group["shard"].iloc[0]), f.seed, f.segment, f.spread, f.cells.tobytes()]],
        columns=["shard", "seed", "segment", "spread", "cells"],
    )


def _screen(batch: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    hit = np.zeros(len(batch), bool)
    keys = batch["key"].to_numpy(np.int64).view(np.uint64)
    for f in filters.itertuples():
        cells = np.frombuffer(f.cells, np.uint8)
        hit |= FuseFilter(int(f.seed), int(f.segment), int(f.spread), cells).holds(keys)
    return pd.DataFrame({"sha": batch["sha"][hit]})


def shard_of(sha: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(sha), F.lit(shards)).cast("int")


def _key(sha: Column) -> Column:
    """63 bits of the digest: the key that the filters hold."""
    return F.conv(F.hex(F.substring(sha, 1, 8)), 16, -10).cast("bigint")


def build_filters(classes: DataFrame, shards: int) -> DataFrame:
    """One filter per shard of the distinct digests `sha` of a snapshot."""
    keyed = classes.select(shard_of(F.col("sha"), shards).alias("shard"), _key(F.col("sha")).alias("key"))
    return keyed.groupBy("shard").applyInPandas(_build, _FILTER)


def screen(classes: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The digests of a batch that the snapshot may hold."""
    keyed = classes.select(shard_of(F.col("sha"), shards).alias("shard"), _key(F.col("sha")).alias("key"), "sha")
    return keyed.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(_screen, "sha binary")


def _equal_bytes(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of the matching digests, those whose two representatives have equal normalised texts.

    An id may head several rows, so rows are told apart by their digest too."""
    ends = pairs.select("sha", F.col("s_id").alias("id"), F.lit(0).alias("side")).union(
        pairs.select("sha", F.col("b_id").alias("id"), F.lit(1).alias("side"))
    )
    thin = screened(texts, F.col("__id"), ends, "id")
    met = thin.join(ends, thin["__id"].eqNullSafe(ends["id"])).select("sha", "side", normalised(F.col("__text")).alias("norm"))
    met = met.filter(F.unhex(F.sha2("norm", 256)) == F.col("sha"))
    one = met.groupBy("sha").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"), F.min("side").alias("x"), F.max("side").alias("y"))
    return one.filter("lo = hi and x = 0 and y = 1").select("sha")


def exact_dedup(
    docs: DataFrame, *, in_snapshot: Column, id_col: str = "doc_id", text_col: str = "text", shard_keys: int = SHARD_KEYS
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per row of `docs`.

    `in_snapshot` marks the rows of the immutable snapshot; the rest is the incoming batch.
    """
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    rows = settle(
        docs.select(
            F.col(id_col).alias("id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("sha"),
            F.when(F.coalesce(in_snapshot, F.lit(False)), 0).otherwise(1).alias("side"),
        ).groupBy("sha", "side", "id").agg(F.count(F.lit(1)).alias("rows"))
    )
    classes = settle(rows.groupBy("side", "sha").agg(F.min("id").alias("id"), F.sum("rows").alias("n")))
    old, new = (classes.filter(F.col("side") == k).drop("side") for k in (0, 1))
    shards = max(1, math.ceil(old.count() / shard_keys))
    filters = settle(build_filters(old, shards))
    maybe = screen(new, filters, shards)
    pairs = settle(
        new.join(maybe, "sha").select("sha", F.col("id").alias("b_id"), F.col("n").alias("b_n"))
        .join(old.select("sha", F.col("id").alias("s_id"), F.col("n").alias("s_n")), "sha")
    )
    same = pairs.join(_equal_bytes(texts, pairs), "sha").select(
        "sha", F.least("s_id", "b_id").alias("m_id"), (F.col("s_n") + F.col("b_n")).alias("m_n")
    )
    whole = classes.join(settle(same), "sha", "left").select(
        "sha", "side", F.coalesce("m_id", "id").alias("keep_id"), F.coalesce("m_n", "n").alias("group_size")
    )
    # In a class that spans both sides, only the row with the smallest id of all stays.
    first = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return (
        rows.join(whole, ["sha", "side"])
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
        .select(
            F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("bigint").alias("group_size"),
            first.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), F.col("side").alias("batch"),
        )
    )


def keep_first(docs: DataFrame, *, in_snapshot: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    found = exact_dedup(docs, in_snapshot=in_snapshot, id_col=id_col, text_col=text_col)
    stay = found.filter("kept").select(F.col(id_col).alias("__id"), F.unhex("text_sha256").alias("__sha"))
    # Rows with one id are told apart by their digest; rows equal in both are copies, of which one is kept.
    keyed = docs.withColumn("__key", F.unhex(F.sha2(normalised(F.col(text_col)), 256)))
    met = keyed.join(stay, keyed[id_col].eqNullSafe(stay["__id"]) & (keyed["__key"] == stay["__sha"]), "left_semi")
    return met.dropDuplicates([id_col, "__key"]).drop("__key")


def halves(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """A snapshot of the lower half of the id range, as if the upper half came in later."""
    ends = docs.agg(F.min(id_col), F.max(id_col)).first()
    return F.lit(False) if ends[0] is None else F.col(id_col) <= (ends[0] + ends[1]) // 2
