import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from oddsloom.llm import exact_dedup as ex
from oddsloom.llm import minhash as mh
from oddsloom.llm import suffix_dedup as sd
from oddsloom.llm.common import components
from oddsloom.llm.embedding_dedup import embedding_dedup, quantised, unit
from oddsloom.llm.words import span_hashes, text_slices, word_spans
from tests.llm.data import VECTORS, documents, edited, frame, prose


class Forest:
    def __init__(self, nodes):
        self.root = {n: n for n in nodes}

    def find(self, x):
        while self.root[x] != x:
            x = self.root[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)


def test_components_are_those_of_union_find(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7), (5000, 5000)]
    forest = Forest({x for e in edges for x in e})
    for a, b in edges:
        forest.link(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: forest.find(n) for n in forest.root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- exact ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 5_000])
def test_fuse_filter_holds_its_keys_and_little_else(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    f = ex.FuseFilter.build(keys)
    assert f.holds(keys).all()
    assert f.holds(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)).mean() < 0.01


def test_exact_dedup_equals_grouping(spark):
    rows = documents()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[norm(t)].append(d)
    docs = frame(spark, rows)
    found = ex.exact_dedup(docs, in_snapshot=ex.halves(docs), shard_keys=8).collect()
    assert len(found) == len(rows)
    kept = Counter()
    for r in found:
        text = next(norm(t) for d, t, *_ in rows if d == r.doc_id and hashlib.sha256(norm(t).encode()).hexdigest() == r.text_sha256)
        ids = [d for d in groups[text] if d is not None]
        assert r.keep_id == min(ids, default=None) and r.group_size == len(groups[text])
        kept[text] += r.kept
    assert set(kept.values()) == {1} and set(kept) == set(groups)
    stay = ex.keep_first(docs, in_snapshot=ex.halves(docs))
    assert stay.columns == docs.columns and stay.count() == len(groups)


def test_exact_dedup_of_nothing(spark):
    docs = frame(spark, [])
    assert ex.exact_dedup(docs, in_snapshot=ex.halves(docs)).count() == 0
    only = frame(spark, [(1, "a", None, None)])
    assert [r.kept for r in ex.exact_dedup(only, in_snapshot=ex.halves(only)).collect()] == [True]


# --- near ----------------------------------------------------------------------------------------------------


def test_word_spans_and_hashes_are_those_of_split():
    import pyarrow as pa

    texts = ["a bb  ccc", "", None, " é\tü\n", "bb", " x", "中 bb"]
    seen = {}
    for slice_bytes in (1, 6, 1 << 20):
        for row, data, offsets in text_slices(pa.array(texts), slice_bytes):
            starts, ends, before = word_spans(data, offsets)
            words = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
            want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts[row : row + len(offsets) - 1]]
            assert [words[a:b] for a, b in zip(before[:-1], before[1:])] == want
            for w, h in zip(words, span_hashes(data, starts, ends)):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("weights", [False, True])
def test_dart_minhash_estimates_weighted_similarity(weights):
    rng = np.random.default_rng(2)
    got, want = [], []
    for _ in range(40):
        universe = np.sort(rng.choice(1 << 40, 60, replace=False)).astype(np.uint64)
        w = rng.integers(0, 6, (2, 60)) if weights else rng.integers(0, 2, (2, 60))
        w[0] = np.where(rng.random(60) < 0.7, w[1], w[0])
        want.append(np.minimum(*w).sum() / np.maximum(*w).sum())
        text, at = np.nonzero(w)
        signature = mh.dart_minhash(text, universe[at], w[text, at].astype(float), 2, 140)
        got.append((signature[0] == signature[1]).mean())
    assert abs(np.mean(got) - np.mean(want)) < 0.02 and np.abs(np.array(got) - want).max() < 0.2


def classes_by_force(texts: dict[int, str], counts: bool = False) -> dict[int, int]:
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
        return c if counts else Counter(set(c))

    sets, forest = {d: shingles(t) for d, t in texts.items()}, Forest(texts)
    for a in texts:
        for b in texts:
            if a < b and (sets[a] == sets[b] or sets[a] and sum((sets[a] & sets[b]).values()) >= 0.8 * sum((sets[a] | sets[b]).values())):
                forest.link(a, b)
    return {d: forest.find(d) for d in texts}


@pytest.mark.parametrize("path", ["pivots", "pairs", "tiles"])
@pytest.mark.parametrize("counts", [False, True])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, path, counts):
    monkeypatch.setattr(mh, "CROWD", 1 if path == "tiles" else 1000)
    monkeypatch.setattr(mh, "BLOCK", 3)
    base = prose(50, 80)
    rows = documents() + [(200 + i, edited(base, i, i % 9), "xx", "s1") for i in range(25)]
    want = classes_by_force({d: t for d, t, *_ in rows if d is not None}, counts)
    found = mh.near_duplicates(frame(spark, rows), pivot_rounds=2 if path == "pivots" else 0, counts=counts).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: r.class_id for r in found if r.doc_id is not None} == want
    sizes = Counter(want[d] for d, *_ in rows if d is not None)
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in found if r.doc_id is not None)
    assert all(r.kept and r.class_id is None for r in found if r.doc_id is None)


@pytest.mark.parametrize("counts", [False, True])
def test_near_duplicates_at_the_registered_settings(spark, counts):
    base, other = prose(51, 90), prose(52, 70)
    rows = [(i, edited(base, i, i % 8), "xx", "s") for i in range(40)] + [(100 + i, edited(other, i, i % 7), "xx", "s") for i in range(30)]
    want = classes_by_force({d: t for d, t, *_ in rows}, counts)
    assert {r.doc_id: r.class_id for r in mh.near_duplicates(frame(spark, rows), counts=counts).collect()} == want


def test_an_id_with_several_texts_loses_none_of_them(spark):
    a, b, c = prose(61, 80), prose(62, 80), prose(63, 80)
    rows = [(1, a, "xx", "s"), (5, edited(a, 1, 1), "xx", "s"), (5, b, "xx", "s"), (7, c, "xx", "s"), (7, c, "xx", "s"), (8, edited(c, 2, 1), "xx", "s"),
            (9, b + " more words at its end", "xx", "s"), (None, a, "xx", "s"), (11, a, "xx", "s"), (11, edited(a, 3, 1), "xx", "s")]
    kept = mh.drop_near_duplicates(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, a), (5, b), (7, c), (7, c), (None, a)])
    found = Counter((r.doc_id, r.class_id, r.class_size, r.kept) for r in mh.near_duplicates(frame(spark, rows)).collect())
    assert found == Counter([(1, 1, 4, True), (5, 1, 4, False), (5, 5, 2, True), (7, 7, 3, True), (7, 7, 3, True), (8, 7, 3, False), (9, 5, 2, False),
                             (None, None, 1, True), (11, 1, 4, False), (11, 1, 4, False)])
    # Two texts of the smallest id: the first by its digest stays.
    two = mh.near_duplicates(frame(spark, [(3, a, "xx", "s"), (3, edited(a, 1, 1), "xx", "s")])).collect()
    assert sorted(r.kept for r in two) == [False, True]


def test_near_duplicates_of_nothing(spark):
    assert mh.near_duplicates(frame(spark, [])).count() == 0
    assert mh.drop_near_duplicates(frame(spark, [(1, None, None, None)])).count() == 1


# --- passages ------------------------------------------------------------------------------------------------


def repeats_by_force(raws: list[bytes], width: int = 200) -> list[tuple]:
    seen = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = b"\x01" * width
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((len(r), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(r, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [2_000, 1])
def test_repeats_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(sd.repeats, "__defaults__", (sd.SPLITS, crowd))
    monkeypatch.setattr(sd, "SHARD_BYTES", 2_000)
    passage = prose(60, 70)
    rows = documents() + [(300 + i, f"{prose(300 + i, 20)} {passage[i % 4 :]} {prose(400 + i, 20)}", "xx", "s1") for i in range(12)]
    rows += [(400, passage + passage, "xx", "s1"), (401, passage[:199], "xx", "s1"), (402, prose(61, 60) + " " + passage[:199], "xx", "s1"), (403, "q" * 200, "xx", "s1"), (404, "q" * 201, "xx", "s1")]
    want = Counter((d, *x) for (d, *_), x in zip(rows, repeats_by_force([(t or "").encode() for _, t, *_ in rows])))
    found = sd.remove_repeats(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in found)


def test_repeats_of_nothing(spark):
    assert sd.remove_repeats(frame(spark, [])).count() == 0


def test_merged_shards_order_all_windows():
    strings = [prose(i, 40).encode()[:210] for i in range(6)] + [prose(1, 40).encode()[3:207]]
    windows = np.array([len(s) - 199 for s in strings])
    shards = [sd.Shard(strings[a:b], windows[a:b]) for a, b in ((0, 2), (2, 5), (5, 7))]
    window, opens = sd.merged_blocks(shards)
    flat = [s[i : i + 200] for s in strings for i in range(len(s) - 199)]
    assert [flat[w] for w in window] == sorted(flat)
    assert list(opens) == [i == 0 or sorted(flat)[i] != sorted(flat)[i - 1] for i in range(len(flat))]


# --- embeddings ----------------------------------------------------------------------------------------------


def test_quantisation_bound_is_rigorous():
    rng = np.random.default_rng(4)
    for d in (1, 3, 64, 300):
        u = unit(rng.normal(size=(60, d)) * np.exp(rng.normal(size=(60, 1)) * 200))
        codes, steps, errors = quantised(u)
        near = (codes.astype(float) @ codes.T.astype(float)) * steps[:, None] * steps
        assert (np.abs(near - u @ u.T) <= errors[:, None] + (1 + errors[:, None]) * errors + 1e-12).all()


@pytest.mark.parametrize("block", [4096, 7])
def test_embedding_links_equal_brute_force(spark, block):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(4, 16))
    rows = [(i, (centre[i % 4] + rng.normal(size=16) * 0.25 * (i % 7)).tolist(), i % 3) for i in range(120)]
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(6)] + [(0, rows[0][1], 0), (300, [2 * x for x in rows[1][1]], 1)]
    rows += [(310, None, 1), (311, [0.0] * 16, 1), (312, [math.nan] * 16, 1), (313, [math.inf] + [1.0] * 15, 1), (314, [None] + [1.0] * 15, 1), (315, [], 1)]
    rows += [(316, rows[1][1], None), (None, rows[1][1], 1), (317, rows[1][1][:8], 1), (318, [1e-200 * x for x in rows[1][1]], 1), (319, [1e200 * x for x in rows[1][1]], 1)]
    fine = lambda r: r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    def cosine(a, b):
        a, b = (np.array(v) / max(map(abs, v)) for v in (a, b))
        return a @ b / math.sqrt((a @ a) * (b @ b))

    forest, links = Forest({r[0] for r in rows if r[0] is not None}), Counter()
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if i != j and fine(a) and fine(b) and a[2] == b[2] and len(a[1]) == len(b[1]) and cosine(a[1], b[1]) >= 0.93:
                links[i] += 1
                forest.link(a[0], b[0])
    want = Counter((r[0], links[i], None if r[0] is None else forest.find(r[0])) for i, r in enumerate(rows))
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    found = embedding_dedup(table, block=block).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in found) == want
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in found)
    assert embedding_dedup(table.filter("false")).count() == 0
