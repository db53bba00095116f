"""Near-dedup of embeddings: int8 tile products with rigorous error bounds, full precision where they leave doubt.

Equal vectors of a label are one representative. Representatives of a label are dealt into blocks of bounded
size by hash; each pair of blocks is one tile. In a tile the integer products of the quantised unit vectors
give every cosine up to a bound that follows from the two quantisation errors: pairs surely above or below the
threshold are settled by it, and only those in between are recomputed in double precision. A tile returns link
counts and a spanning forest of its links, never its pairs, so dense groups cost no more output than loose ones.

For u = s q + e (unit u, step s, integers q, error e) and w alike:
|<u, w> - s_u s_w <q_u, q_w>| = |<e_u, w> + <s_u q_u, e_w>| <= |e_u| + (1 + |e_u|) |e_w|.

Nulls: a row whose id, label or vector is null, or whose vector is empty, zero or holds null or non-finite
components, links with nothing. Vectors of different lengths never link. Repeated rows are copies and link
with each other; rows that share an id share a component. Other columns are ignored. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.llm.common import components
from oddsloom.session import settle

THRESHOLD = 0.93
BLOCK = 4096
#: Rows of a block multiplied at a time.
STRIP = 512
#: Covers the rounding of the double arithmetic around the bound itself.
SLACK = 1e-9

_PACKED = "label string, dim int, blocks int, block int, ids binary, hashes binary, weights binary, vectors binary"
_TILE = "id long, hash long, links long, other long"


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _pack(group: pd.DataFrame) -> pd.DataFrame:
    first = group.iloc[0]
    parts = [np.array(group[k].tolist(), t).tobytes() for k, t in (("rep", "i8"), ("hash", "i8"), ("n", "i8"), ("vec", "f8"))]
    return pd.DataFrame([[first.label, first.dim, first.blocks, first.block, *parts]], columns=_PACKED.replace(",", "").split()[::2])


def unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; a power-of-two scale first, so that squares neither overflow nor vanish."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    scaled = np.ldexp(vectors, -exponent[:, None])
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def quantised(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, steps and error norms of unit vectors."""
    steps = np.abs(units).max(axis=1) / 127
    codes = np.rint(units / steps[:, None]).astype(np.int8)
    errors = units - steps[:, None] * codes
    return codes, steps, np.sqrt(np.einsum("ij,ij->i", errors, errors))


class _Side:
    def __init__(self, row):
        self.ids, self.hashes, self.weights = (np.frombuffer(getattr(row, k), "i8") for k in ("ids", "hashes", "weights"))
        self.unit = unit(np.frombuffer(row.vectors, "f8").reshape(len(self.ids), row.dim))
        codes, self.steps, self.errors = quantised(self.unit)
        # Integer products in the float type that holds them exactly.
        self.codes = codes.astype("f4" if row.dim * 127 * 127 < 1 << 24 else "f8")


def hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the trees of `root` along the links a-b, smallest position first."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def _links(left: _Side, right: _Side, threshold: float, same: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Boolean link strips of a tile, with the position of their first row."""
    for at in range(0, len(left.ids), STRIP):
        s = slice(at, at + STRIP)
        near = (left.codes[s] @ right.codes.T).astype("f8") * left.steps[s, None] * right.steps
        doubt = left.errors[s, None] + (1 + left.errors[s, None]) * right.errors + SLACK
        link = near - doubt >= threshold
        i, j = np.nonzero((near + doubt >= threshold) & ~link)
        for k in range(0, len(i), 1 << 15):
            p, q = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            link[p, q] = np.einsum("ij,ij->i", left.unit[at + p], right.unit[q]) >= threshold
        if same:
            link &= np.arange(len(right.ids)) > np.arange(at, at + len(link))[:, None]
        yield at, link


def _tile(threshold: float):
    def run(blocks: pd.DataFrame) -> pd.DataFrame:
        sides = [_Side(r) for r in blocks.sort_values("block").itertuples()]
        same, left, right = len(sides) == 1, sides[0], sides[-1]
        base = 0 if same else len(left.ids)
        ids = left.ids if same else np.concatenate([left.ids, right.ids])
        hashes = left.hashes if same else np.concatenate([left.hashes, right.hashes])
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for at, link in _links(left, right, threshold, same):
            links[at : at + len(link)] += link @ right.weights
            links[base:] += left.weights[at : at + len(link)] @ link
            i, j = np.nonzero(link)
            hook(root, at + i, base + j)
        met = links > 0
        return pd.DataFrame({"id": ids[met], "hash": hashes[met], "links": links[met], "other": ids[root[met]]})

    return run


def embedding_dedup(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    threshold: float = THRESHOLD, block: int = BLOCK,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of `vectors`."""
    key = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), key.alias("vec"))
    rows = rows.withColumn("label", F.when(_usable(F.col("vec")) & F.col("id").isNotNull(), F.col("label")))
    copies = rows.filter("label is not null").groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    reps = settle(copies.withColumns({"hash": F.xxhash64("label", "vec"), "dim": F.size("vec")}))
    sizes = reps.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = reps.join(sizes, ["label", "dim"]).withColumn("block", F.pmod("hash", F.col("blocks")).cast("int"))
    packed = settle(dealt.groupBy("label", "dim", "block").applyInPandas(_pack, _PACKED))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = packed.withColumn("partner", every).withColumns(
        {"i": F.least("block", "partner"), "j": F.greatest("block", "partner")}
    )
    found = settle(tiles.drop("partner").groupBy("label", "dim", "i", "j").applyInPandas(_tile(threshold), _TILE))
    class_of = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("id", "hash").agg(F.sum("links").alias("links")).withColumnRenamed("id", "rep")
    known = (
        reps.join(links, ["rep", "hash"], "left")
        .join(class_of.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    return rows.join(known, ["label", "vec"], "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(False)).alias("kept"),
    )
