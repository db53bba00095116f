import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from oddsloom.llm import collocations as co
from tests.llm.data import DOCS, documents, frame, prose


def brute(rows, longest, min_count, absorb, top):
    """(lang, rank, phrase, a, l, r, n, score) by spelling out every phrase."""
    low = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    f, n, out = {}, Counter(), []
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(low)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for m in range(1, longest + 1):
                    if i + m <= len(words):
                        f.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        inside = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        kept = []
        for p, a in found.items():
            if inside[p] and 100 * inside[p] >= absorb * a:
                continue
            score, k = min((co.SCALE * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


TALK = [
    (1, "New York is big. New York, New  York\tis NEW york! of the of the of the", "en", "s"),
    (2, "of the city of new york is of the old: ÉCOLE École É\nof the\rof the", "en", "s"),
    (2, "of the city of new york is of the old: ÉCOLE École É\nof the\rof the", "en", "s"),
    (3, "new york is of the", None, "s"), (4, "new york is of the new york", "und", "s"), (None, "new york is", "en", None), (5, None, "en", "s"),
    (6, "", None, None), (7, " \t.,;", "en", "s"), (8, "a b " * 400 + "a a a a a a", "fr", "s"), (9, "x " * 30, "fr", "s"), (10, "new;york new. york", "xx", "s"),
]


@pytest.mark.parametrize("longest, min_count, absorb, top", [(3, 2, 50, 2000), (2, 2, 50, 5), (4, 3, 80, 2000), (5, 1, 100, 2000), (3, 10, 50, None)])
def test_equals_brute_force(spark, longest, min_count, absorb, top):
    got = co.collocations(frame(spark, TALK), longest=longest, min_count=min_count, absorb=absorb, top=top)
    assert rows_of(got) == brute(TALK, longest, min_count, absorb, top)


@pytest.mark.parametrize("slice_bytes, hot, buckets", [(64, 1 << 19, 3), (1 << 22, 3, 4), (64, 0, 2), (1 << 22, 0, 1)])
def test_slices_buckets_and_hot_words_change_nothing(spark, monkeypatch, slice_bytes, hot, buckets):
    for name, value in (("SLICE_BYTES", slice_bytes), ("HOT", hot), ("BUCKETS", buckets), ("SEEN", 1)):
        monkeypatch.setattr(co, name, value)
    rows = documents() + TALK + [(900 + i, prose(i % 4, 50) + " alpha beta gamma.", "xx", "s") for i in range(12)]
    for longest in (2, 3, 4):
        got = co.collocations(frame(spark, rows), min_count=3, longest=longest)
        assert rows_of(got) == brute(rows, longest, 3, 50, 2000)


def test_odd_words_survive_packing(spark):
    odd = ["\ufeff", "\ufeffa", '"', "'", "a\x00b", "\x85", "\u2028", "null", "NULL", "NA", "\\", "#", "1", "\U0001f600", "w1"]
    rows = [(i, " ".join(odd[k:] + odd[:k]), "l 1\n", "s") for i in range(3) for k in range(len(odd))]
    assert rows_of(co.collocations(frame(spark, rows), min_count=2)) == brute(rows, 3, 2, 50, 2000)


def test_a_hot_word_is_dealt_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(co, "HOT", 200)
    monkeypatch.setattr(co, "SEEN", 1)
    text = " ".join(f"the of w{i}" for i in range(600))
    texts = frame(spark, [(1, text, "xx", "s")]).selectExpr("text", "lang")
    hot, words = co.hot_slots(texts)
    assert words == 1800 and 3 <= hot.sum() <= 6
    packed = texts.mapInArrow(co._pack(3, 64, spark.sparkContext.broadcast(hot)), "bucket int, lang string, block binary")
    sizes = [len(co.zstandard.ZstdDecompressor().decompress(r.block).splitlines()) for r in packed.collect()]
    assert sum(sizes) == 1800 and max(sizes) < 60


def test_sums_without_room_for_one_key():
    import numpy as np

    rows = np.array([[0, 0, 1, 0], [5, 5, 5, 5], [0, 7, 7, 0]])
    for base in (8, 1 << 40):
        held, n = co._summed(rows, np.array([1, 2, 4, 8]), base)
        assert held.tolist() == [[0, 0, 1], [5, 5, 5], [0, 7, 7]] and n.tolist() == [9, 2, 4]


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 999_999_999_937, 1_000_000_000_039, 999_999_999_989
    df = spark.createDataFrame([(a, left, right), (3, 3, 3), (10, 20, 11)], "a long, l long, r long")
    got = [r[0] for r in df.select(co.exact_score(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [co.SCALE * x * x // (y * z) for x, y, z in [(a, left, right), (3, 3, 3), (10, 20, 11)]]


def test_no_rows(spark):
    assert co.collocations(spark.createDataFrame([], DOCS)).collect() == []
    assert co.collocations(frame(spark, [(1, None, None, None)])).collect() == []
