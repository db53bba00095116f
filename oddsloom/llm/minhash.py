"""Near-duplicate documents by DartMinHash.

A document is a weighted set of five-word shingles. Every shingle owns a plane of weight by rank on which darts
lie as a Poisson process of unit density, the same in every document: a seeded hash gives each unit cell its
darts. A document takes the darts below a shingle's weight and below a rank bound that suits its total weight,
and keeps the earliest dart of each of `t` coordinates; documents with an empty coordinate raise their bound.
Equal coordinates of two documents then have the probability of their weighted Jaccard similarity, and a
signature costs the shingles plus about t log t darts. Bands of equal coordinates give candidates; all of them
that can matter are checked on the exact shingle sets.

Texts with equal words are one representative. Within a band bucket every member first meets one pivot; only where a bucket still spans several classes are the remaining pairs across classes looked at, since
pairs within a class change nothing. Small buckets list those pairs; crowded ones are cut into blocks, and each
pair of blocks is a tile that compares its texts in place and returns a spanning forest of the links it finds, so
its output does not grow with the square of a group. No pair of a bucket that could join two classes is left out.

Nulls: a null text is empty; texts without words are copies of each other; texts of fewer than five words are
one shingle. Rows without id are left alone: class null, kept. Rows are told apart by the digest of their words, not by
id: an id with several texts is in the classes of all of them, and each row has the verdict of its own text. Repeated rows
share class and verdict. Other columns are ignored. No rows: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructType

from oddsloom.llm.common import components, screened, unscreened
from oddsloom.llm.embedding_dedup import hook
from oddsloom.llm.words import mix64, span_hashes, text_slices, word_spans
from oddsloom.session import settle

SHINGLE = 5
THRESHOLD = 0.8
#: 28 bands of 5: a pair at the threshold is missed with probability 1.5e-5.
BANDS, ROWS = 28, 5
#: Rounds in which a bucket's members meet a single pivot.
PIVOT_ROUNDS = 1
SEED = 7
#: Members up to which a bucket lists its pairs; members and shingles of a block of a larger one.
CROWD = 16
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
SHINGLE_BITS = 48

_SIGNED = StructType().add("id", "long").add("digest", "binary").add("total", "double").add("bands", ArrayType(LongType()))
_SETS = StructType().add("doc", "long").add("digest", "binary").add("shingles", "binary").add("weights", "binary")
#: Running probabilities of 0, 1, 2, ... darts in a unit cell.
_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1.0, k + 1)) for k in range(20)])


def shingle_sets(words: np.ndarray, before: np.ndarray, k: int = SHINGLE, counts: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of each distinct shingle of each text, sorted; weight 1 or its count.

    A text of fewer than `k` words, but one at least, is a single shingle."""
    per = np.diff(before)
    full, short = np.repeat(per >= k, per), np.flatnonzero((per > 0) & (per < k))
    owner = np.repeat(np.arange(len(per)), per)
    last = np.repeat(before[1:] - k, per)
    first = np.flatnonzero(full & (np.arange(len(words)) <= last))
    value = np.zeros(len(first), np.uint64)
    for i in range(k):
        value += mix64(words[first + i] + np.uint64(i + 1))
    texts = owner[first]
    few = [np.add.reduce(mix64(words[before[d] : before[d + 1]] + np.arange(101, 101 + per[d], dtype=np.uint64))) for d in short]
    texts = np.concatenate([texts, short]).astype(np.uint64)
    value = mix64(np.concatenate([value, np.array(few, np.uint64)])) >> np.uint64(64 - SHINGLE_BITS)
    held, n = np.unique((texts << np.uint64(SHINGLE_BITS)) | value, return_counts=True)
    text, shingle = held >> np.uint64(SHINGLE_BITS), held & np.uint64((1 << SHINGLE_BITS) - 1)
    return text.astype(np.int64), shingle, n.astype("f8") if counts else np.ones(len(n))


def dart_minhash(text: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, t: int, seed: int = SEED) -> np.ndarray:
    """Signatures (texts x t) of weighted sets given as rows sorted by text; zero where a text has no element."""
    total = np.bincount(text, weight, texts)
    out = np.zeros((texts, t), np.uint64)
    open_ = np.flatnonzero(total > 0)
    bound = t * (np.log(t) + 2) / np.maximum(total, 1e-300)
    while len(open_):
        use = np.isin(text, open_) if len(open_) < texts else slice(None)
        d, e, w = text[use], element[use], weight[use]
        # Unit cells of a row: weight by rank, up to its weight and to its text's rank bound.
        deep, high = np.ceil(w).astype(np.int64), np.ceil(bound[d]).astype(np.int64)
        cells = deep * high
        row = np.repeat(np.arange(len(d)), cells)
        at = np.arange(len(row)) - np.repeat(np.cumsum(cells) - cells, cells)
        v, r = at // high[row], at % high[row]
        cell = mix64(mix64(mix64(e[row] + np.uint64(seed)) + v.astype(np.uint64)) + r.astype(np.uint64))
        darts = np.searchsorted(_POISSON, (cell >> np.uint64(11)).astype("f8") * 2.0**-53, "right")
        row, v, r, cell = (np.repeat(x, darts) for x in (row, v, r, cell))
        turn = np.arange(len(row)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix64(cell + (turn + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        place = mix64(dart)
        rank = r + (place >> np.uint64(32)).astype("f8") * 2.0**-32
        lies = v + (place & np.uint64(0xFFFFFFFF)).astype("f8") * 2.0**-32
        hit = (lies < w[row]) & (rank <= bound[d[row]])
        rank, dart, slot = rank[hit], dart[hit], d[row[hit]] * t + (mix64(dart[hit] + np.uint64(1)) % np.uint64(t)).astype(np.int64)
        best = np.full(texts * t, np.inf)
        np.minimum.at(best, slot, rank)
        won = rank == best[slot]
        flat = np.zeros(texts * t, np.uint64)
        np.maximum.at(flat, slot[won], dart[won])
        got, full = flat.reshape(texts, t), np.isfinite(best.reshape(texts, t)).all(axis=1)
        done = open_[full[open_]]
        out[done] = got[done]
        open_ = open_[~full[open_]]
        bound[open_] *= 2
    return out


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, rows)
    value = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
    for i in range(rows):
        value = mix64(value + parts[:, :, i])
    return value.view(np.int64)


def _words(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, word hashes, words before each text) of the slices of a batch."""
    for row, data, offsets in text_slices(batch.column("text")):
        starts, ends, before = word_spans(data, offsets)
        yield batch.column("id").slice(row, len(offsets) - 1), span_hashes(data, starts, ends), before


def _digests(words: np.ndarray, before: np.ndarray) -> list[bytes]:
    """Of the words of each text."""
    raw = words.tobytes()
    return [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(before[:-1], before[1:])]


def _told(text_col: str, schema: pa.Schema):
    """Rows with the digest of their words behind their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text_col)
            found = [d for _, words, before in _words(pa.RecordBatch.from_arrays([pa.nulls(len(batch)), column], names=["id", "text"])) for d in _digests(words, before)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], schema=schema)

    return run


def _sign(k: int, counts: bool, bands: int, rows: int, seed: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, before in _words(batch):
                n = len(ids)
                text, shingle, weight = shingle_sets(words, before, k, counts)
                signature = dart_minhash(text, shingle, weight, n, bands * rows, seed)
                flat = pa.array(band_hashes(signature, bands, rows).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), flat)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(_digests(words, before), pa.binary()), pa.array(np.bincount(text, weight, n)), lists.cast(schema.field("bands").type)], schema=schema
                )

    return run


def _gather(k: int, counts: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, before in _words(batch):
                text, shingle, weight = shingle_sets(words, before, k, counts)
                cut = np.searchsorted(text, np.arange(len(ids) + 1))
                sets, weights = ([x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])] for x in (shingle, weight.astype("f4")))
                found = [pa.array(x, pa.binary()) for x in (_digests(words, before), sets, weights)]
                yield pa.RecordBatch.from_arrays([ids, *found], schema=schema)

    return run


def weighted_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum of minima over sum of maxima of two sets sorted by element."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = b[at] == a if len(b) else np.zeros(len(a), bool)
    low = np.minimum(wa[both], wb[at[both]]).sum(dtype="f8")
    whole = wa.sum(dtype="f8") + wb.sum(dtype="f8") - low
    return low / whole if whole else 1.0


def _check(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [
                weighted_jaccard(np.frombuffer(s, "u8"), np.frombuffer(v, "f4"), np.frombuffer(s2, "u8"), np.frombuffer(v2, "f4")) >= threshold
                for s, v, s2, v2 in zip(*(batch.column(k).to_pylist() for k in ("sa", "wa", "sb", "wb")), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(near, pa.bool_())) for k in ("a", "b")], names=["a", "b"])

    return run


def sets_of(ids: DataFrame, texts: DataFrame, places: DataFrame, k: int, counts: bool) -> DataFrame:
    """(id, shingles, weights) of some representatives; `places` (id, doc, digest) has where each one's text is found."""
    wanted = settle(places.join(ids, "id", "left_semi"))
    met = screened(texts, F.col("id"), wanted, "doc").join(wanted.select(F.col("doc").alias("id")), "id", "left_semi")
    sets = met.mapInArrow(_gather(k, counts, to_arrow_schema(_SETS)), _SETS).drop("doc")
    return sets.join(wanted.select("id", "digest"), "digest").dropDuplicates(["digest"]).select("id", "shingles", "weights")


def near_pairs(pairs: DataFrame, texts: DataFrame, places: DataFrame, *, threshold: float, k: int, counts: bool) -> DataFrame:
    """The candidate pairs (a, b) whose exact similarity reaches the threshold. Only their texts are fetched."""
    ids = settle(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    sets = settle(sets_of(ids, texts, places, k, counts))
    one, two = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}"), F.col("weights").alias(f"w{x}")) for x in "ab")
    return pairs.join(one, "a").join(two, "b").mapInArrow(_check(threshold), "a long, b long")


def _similarities(x: tuple, others: list[tuple]) -> np.ndarray:
    """Weighted Jaccard similarity of a set to each of several, all as (elements, weights) sorted by element."""
    element, weight = x
    sizes = np.array([len(e) for e, _ in others])
    flat, flat_w = np.concatenate([e for e, _ in others]), np.concatenate([w for _, w in others]).astype("f8")
    at = np.minimum(np.searchsorted(element, flat), len(element) - 1)
    low = np.where(element[at] == flat, np.minimum(weight[at], flat_w), 0)
    starts = np.cumsum(sizes) - sizes
    shared = np.add.reduceat(low, starts)
    return shared / (weight.sum(dtype="f8") + np.add.reduceat(flat_w, starts) - shared)


def _tile(threshold: float):
    """Links across classes between the texts of two blocks of a bucket (or within one), as a spanning forest.

    Pairs that already met in an earlier band are left to it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block", kind="stable")
        blocks = rows["block"].to_numpy()
        cut = int(np.searchsorted(blocks, blocks[0], "right"))
        left, right = (slice(0, cut), slice(cut, None)) if cut < len(rows) else (slice(0, cut), slice(0, cut))
        ids, total = rows["id"].to_numpy(), rows["total"].to_numpy()
        root = np.unique(rows["class"].to_numpy(), return_inverse=True)[1]
        # Trees are positions: every text hangs on the first of its class.
        first = np.full(len(rows), len(rows))
        np.minimum.at(first, root, np.arange(len(rows)))
        root = first[root]
        bands = np.stack(rows["bands"].to_numpy())
        before = int(rows["nth"].iloc[0])
        sets = [(np.frombuffer(s, "u8"), np.frombuffer(w, "f4")) for s, w in zip(rows["shingles"], rows["weights"], strict=True)]
        links = []
        for x in range(left.start, left.stop):
            may = root[right] != root[x]
            may &= np.minimum(total[right], total[x]) >= threshold * np.maximum(total[right], total[x])
            may &= ~(bands[right, :before] == bands[x, :before]).any(axis=1)
            other = np.flatnonzero(may) + right.start
            if right == left:
                other = other[other > x]
            if not len(other):
                continue
            near = other[_similarities(sets[x], [sets[y] for y in other]) >= threshold]
            fresh = near[np.unique(root[near], return_index=True)[1]]
            links += [(ids[x], ids[y]) for y in fresh]
            hook(root, np.full(len(fresh), x), fresh)
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return run


def crowded_links(members: DataFrame, texts: DataFrame, places: DataFrame, *, threshold: float, k: int, counts: bool) -> DataFrame:
    """Links (a, b) across classes in the crowded buckets of `members` (band, nth, id, total, class, bands)."""
    sizes = members.groupBy("band").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("total") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    ids = settle(members.select("id").distinct())
    sets = settle(sets_of(ids, texts, places, k, counts))
    dealt = members.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    tiles = dealt.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.withColumns({"i": F.least("block", "partner"), "j": F.greatest("block", "partner")})
    full = tiles.join(sets, "id").select("band", "i", "j", "nth", "block", "id", "class", "total", "bands", "shingles", "weights")
    return full.groupBy("band", "i", "j").applyInPandas(_tile(threshold), "a long, b long")


def _classified(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, k: int = SHINGLE,
    counts: bool = False, bands: int = BANDS, rows: int = ROWS, pivot_rounds: int = PIVOT_ROUNDS, seed: int = SEED,
) -> DataFrame:
    """(id, digest, class_id, class_size, kept) per row of `docs`; rows without id have no digest."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    signed = texts.mapInArrow(_sign(k, counts, bands, rows, seed, to_arrow_schema(_SIGNED)), _SIGNED)
    # A number per row, fixed as soon as it is written; the smallest of a digest names its text.
    signed = settle(signed.withColumn("row", F.monotonically_increasing_id()))
    named = signed.filter("id is not null")
    heads = named.groupBy("digest").agg(F.min("row").alias("key"), F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    met = named.join(heads.select("digest", F.col("key").alias("row")), ["digest", "row"])
    reps = met.select(F.col("row").alias("id"), F.col("id").alias("doc"), "digest", "total", "bands")
    places = reps.select("id", "doc", "digest")
    spots = reps.filter("total > 0").select(F.posexplode("bands").alias("nth", "band"), "id", "total")
    full = spots.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("band")
    members = settle(spots.join(full, "band"))

    def verified(pairs: DataFrame) -> DataFrame:
        return settle(near_pairs(settle(pairs), texts, places, threshold=threshold, k=k, counts=counts))

    # A ratio of totals below the threshold rules a pair out.
    alike = lambda x, y: F.least(x, y) >= threshold * F.greatest(x, y)
    ends = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    links, tried, split = None, None, members.withColumn("class", F.col("id"))
    for turn in range(pivot_rounds):
        order = F.struct(F.xxhash64("id", F.lit(turn)), "id", "total", "class")
        pivot = split.groupBy("band").agg(F.min(order).alias("p"))
        pairs = split.join(pivot, "band").filter((F.col("class") != F.col("p.class")) & alike(F.col("total"), F.col("p.total")))
        pairs = pairs.select(*ends(F.col("id"), F.col("p.id"))).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = settle(pairs)
        tried = pairs if tried is None else tried.union(pairs)
        found = verified(pairs)
        links = found if links is None else links.union(found)
        class_of = settle(components(links))
        split = members.join(class_of.withColumnRenamed("node", "id"), "id", "left").withColumn(
            "class", F.coalesce("component", "id")
        ).drop("component")
        mixed = split.groupBy("band").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo < hi").select("band")
        split = settle(split.join(mixed, "band"))
    sizes = settle(split.groupBy("band").agg(F.count(F.lit(1)).alias("n")))
    small = split.join(sizes.filter(F.col("n") <= CROWD).select("band"), "band")
    other = small.select("band", *(F.col(c).alias(f"{c}2") for c in ("id", "total", "class")))
    cross = small.join(other, "band").filter((F.col("id") < F.col("id2")) & (F.col("class") != F.col("class2")) & alike(F.col("total"), F.col("total2")))
    cross = cross.select(*ends(F.col("id"), F.col("id2"))).distinct()
    if tried is not None:
        cross = cross.join(tried, ["a", "b"], "left_anti")
    found = verified(cross)
    links = found if links is None else links.union(found)
    crowd = split.join(sizes.filter(F.col("n") > CROWD).select("band"), "band")
    crowd = settle(crowd.join(reps.select("id", "bands"), "id"))
    links = links.union(settle(crowded_links(crowd, texts, places, threshold=threshold, k=k, counts=counts)))
    class_of = components(links)
    groups = heads.join(class_of.withColumnRenamed("node", "key"), "key", "left").withColumn("class", F.coalesce("component", "key"))
    sizes = groups.groupBy("class").agg(F.sum("n").alias("class_size"), F.min(F.struct("rep", "digest")).alias("head"))
    classes = groups.join(sizes, "class").select(
        "digest", F.col("head.rep").alias("class_id"), "class_size", (F.col("digest") == F.col("head.digest")).alias("is_head")
    )
    # Rows without id meet no class.
    keyed = signed.select("id", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest"))
    return keyed.join(classes, "digest", "left").select(
        "id", "digest", "class_id", F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"),
        F.coalesce(F.col("is_head") & (F.col("id") == F.col("class_id")), F.lit(True)).alias("kept"),
    )


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(doc_id, class_id, class_size, kept) per row of `docs`; a class is named by its smallest id.

    Rows of that id with the text that comes first by its digest stay. `counts` weighs a shingle by how often the text
    has it, else every shingle weighs 1."""
    found = _classified(docs, id_col=id_col, text_col=text_col, **settings)
    return found.select(F.col("id").alias(id_col), "class_id", "class_size", "kept")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of `docs` that stay, with all their columns. Rows are dropped by id and digest, so that an id may have several texts.

    Only rows whose id may be among the dropped ones are read for their digest and shuffled to meet them."""
    found = _classified(docs, id_col=id_col, text_col=text_col, **settings)
    gone = settle(found.filter("NOT kept").select(F.col("id").alias("__gone"), F.col("digest").alias("__of")).distinct())
    schema = StructType([*docs.schema.fields]).add("__digest", "binary")
    may = screened(docs, F.col(id_col), gone, "__gone").mapInArrow(_told(text_col, to_arrow_schema(schema)), schema)
    stay = may.join(gone, (F.col(id_col) == F.col("__gone")) & (F.col("__digest") == F.col("__of")), "left_anti").drop("__digest")
    return unscreened(docs, F.col(id_col), gone, "__gone").unionByName(stay)
