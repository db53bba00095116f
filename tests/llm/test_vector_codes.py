import hashlib
import random
from math import floor, inf, isfinite, nan

import numpy as np
import pytest

from oddsloom.llm import vector_codes as vc
from tests.llm.data import VECTORS


def brute(rows, parts, entries, rounds, scale):
    """(vec_id, label, code, error, label_error, digest) with plain integers, every part against its whole codebook."""
    kept = [(i, e, label) for i, e, label, *_ in rows if e is not None and all(x is not None and isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return []
    each = -(-len(kept[0][1]) // parts)
    cut = lambda e: [([floor(x * scale) for x in e] + [0] * (each * parts))[p * each : (p + 1) * each] for p in range(parts)]
    x = [cut(e) for _, e, _ in kept]
    books = [[x[i][p] for i in range(min(entries, len(x)))] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    pick = lambda v, book: min((far(v, c), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in x:
                groups.setdefault(pick(v[p], books[p])[1], []).append(v[p])
            for k, members in groups.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    digits = 4 if entries > 256 else 2
    told = [[pick(v[p], books[p]) for p in range(parts)] for v in x]
    error = [sum(d for d, _ in t) for t in told]
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    by_label = {}
    for (_, _, label), e in zip(kept, error):
        by_label[label] = by_label.get(label, 0) + e
    return [(i, label, "".join(f"{k:0{digits}x}" for _, k in t), e, by_label[label], digest) for (i, _, label), t, e in zip(kept, told, error)]


def vectors(seed, n, width, spread=1.0):
    r = random.Random(seed)
    return [(i, [r.choice([r.gauss(0, spread), round(r.gauss(0, spread), 1)]) for _ in range(width)], r.choice([None, 1, 2]), "rep!", 7) for i in range(n)]


def check(spark, rows, parts=8, entries=16, rounds=6, scale=4096):
    got = vc.compress(spark.createDataFrame(rows, VECTORS).repartition(3), parts=parts, entries=entries, rounds=rounds, scale=scale)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute(rows, parts, entries, rounds, scale)))


@pytest.mark.parametrize("parts, entries, rounds, width", [(8, 16, 6, 16), (4, 5, 3, 8), (3, 4, 0, 7), (1, 300, 2, 3)])
def test_equals_brute_force(spark, parts, entries, rounds, width):
    check(spark, vectors(parts, 400, width), parts, entries, rounds)


def test_awkward_rows(spark):
    rows = vectors(9, 60, 8)
    rows += [(5, rows[5][1], 1, "x", 1), (7, [0.5] * 8, 1, "x", 1), (None, [0.1] * 8, None, "x", 1), (200, None, 1, "x", 1), (201, [0.1, None] * 4, 1, "x", 1),
             (202, [nan] * 8, 1, "x", 1), (203, [inf] + [0.0] * 7, 1, "x", 1), (204, [1.0] * 9, 1, "x", 1), (205, [], 1, "x", 1), (206, [-0.0] * 8, 1, "x", 1)]
    check(spark, rows)


def test_ties_and_copies(spark):
    grid = [(i, [float((i * k) % 3) for k in range(1, 9)], 0, "x", 1) for i in range(90)]
    check(spark, grid)
    check(spark, [(i, [1.0] * 8, 0, "x", 1) for i in range(30)])


def test_few_and_no_vectors(spark):
    check(spark, vectors(1, 3, 8))
    check(spark, [(1, [], None, "x", 1), (2, [], 1, "x", 1)])
    check(spark, [(1, None, 1, "x", 1)])
    assert vc.compress(spark.createDataFrame([], VECTORS)).collect() == []


def test_large_components(spark):
    """Distances that pass 64 bits are told as null; nearest entries stay exact."""
    rows = [(i, [1e7 * ((i * 7) % 11 + 1), float(i)] * 4, 1, "x", 1) for i in range(50)] + [(60, [3e13] * 8, 2, "x", 1)]
    want = brute(rows, 8, 16, 6, 4096)
    got = {r["vec_id"]: r for r in vc.compress(spark.createDataFrame(rows, VECTORS)).collect()}
    assert {i: got[i]["code"] for i in got} == {r[0]: r[2] for r in want}
    assert {r["codebooks_sha256"] for r in got.values()} == {want[0][5]}
    assert all(got[r[0]]["error"] == (r[3] if r[3] < 2**63 else None) for r in want)


def test_active_entries_give_the_full_scan():
    r = np.random.default_rng(3)
    x, book = r.integers(-3, 4, (500, 2)), r.integers(-3, 4, (12, 2))
    held, at = vc.assign(x, book, np.ones(12, bool), None, None, None)
    for _ in range(20):
        moved = r.random(12) < 0.3
        book = np.where(moved[:, None], r.integers(-3, 4, (12, 2)), book)
        part = vc.assign(x, book, moved, held, at, r.random(500) < 0.05)
        full = vc.assign(x, book, moved, None, None, None)
        assert all((a == b).all() for a, b in zip(part, full))
        held, at = part


def test_decoded_vectors_are_near(spark):
    rows = vectors(4, 300, 16)
    state, books = vc.fit_codes(spark.createDataFrame(rows, VECTORS), parts=8, entries=16, rounds=6, scale=4096)
    back = {r["id"]: np.array(r["v"]) for r in vc.decoded(state, books).collect()}
    error = {r["vec_id"]: r["error"] for r in vc.compress(spark.createDataFrame(rows, VECTORS)).collect()}
    for i, v, *_ in rows:
        assert abs(((np.floor(np.array(v) * 4096) - back[i] * 4096) ** 2).sum() - error[i]) < 1e-3
