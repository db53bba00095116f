"""The language stage judges a word by the languages that the field gives it, and drops texts without a letter even where nothing is labelled."""

from collections import Counter
from math import exp, log

import numpy as np
import pytest

import corpus_pipeline
from oddsloom.llm import language as la
from tests.llm.data import documents, frame, prose
from tests.llm.test_switched import ALPHABETS, _learned, _words


def _letters(text):
    raw = text.encode()
    return la.Letters.of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))


def gain_by_force(model, texts, langs):
    """Nats a letter by which a text is likelier than by single letters if its words are in the languages the field gives them; dictionaries,
    text by text and word by word."""
    grams = {lang: Counter() for lang in model.labels}
    for text, lang in zip(texts, langs):
        for w in _words(text):
            grams[lang].update(w[i : i + k] for k in (1, 2, 3) for i in range(len(w) - k + 1))
    letters = Counter()
    for c in grams.values():
        letters.update({g: n for g, n in c.items() if len(g) == 1})
    totals = {lang: sum(n for g, n in c.items() if len(g) == 1) for lang, c in grams.items()}

    def likely(w, lang):
        c = grams[lang]
        one = lambda x: (1 - la.UNSEEN_IN_LANGUAGE) * c[x] / totals[lang] + la.UNSEEN_IN_LANGUAGE
        two = lambda x: (c[x] + la.BACK_OFF * one(x[1])) / (c[x[0]] + la.BACK_OFF)
        three = lambda x: (c[x] + la.BACK_OFF * two(x[1:])) / (c[x[:2]] + la.BACK_OFF)
        return log(one(w[0])) + (log(two(w[:2])) if len(w) > 1 else 0) + sum(log(three(w[i : i + 3])) for i in range(len(w) - 2))

    def plain(w):
        return sum(log((1 - la.UNSEEN) * letters[x] / sum(letters.values()) + la.UNSEEN / (len(letters) + 1)) for x in w)

    def mixed(w, shares):
        logs = [log(max(p, 1e-300)) + likely(w, lang) for p, lang in zip(shares, model.labels)]
        return max(logs) + log(sum(exp(x - max(logs)) for x in logs))

    def gain(text):
        words = _words(text)
        given = model.probabilities(_letters(text or ""))
        assert len(given) == len(words)
        return sum(mixed(w, p) - plain(w) for w, p in zip(words, given)) / sum(map(len, words)) if words else None

    return gain


@pytest.fixture(scope="module")
def model():
    rows = _learned()
    return la.fit([r[1] for r in rows], [r[2] for r in rows], epochs=5)


def test_gain_equals_dictionaries(model):
    rows = _learned()
    gain = gain_by_force(model, [r[1] for r in rows], [r[2] for r in rows])
    for text in ["bad cafe hijk mnlo", "a", "aé zebra Quiz", "ÄB中文 stop", rows[3][1], "cab hi " * 200]:
        words = _letters(text)
        assert np.isclose(model.gains(words).sum() / words.length.sum(), gain(text), rtol=1e-5)


def test_stage_equals_brute_force(spark):
    rows = [r for r in documents() if r[0] is not None] + [(2000 + i, " ".join(prose(7 * i + k, 1, "abcdefghijklmnopqrst"[k % 2 * 5 :]) for k in range(20)), None, None) for i in range(30)]
    docs = frame(spark, rows)
    texts, langs = la.training_sample(
        docs, id_col="doc_id", text_col="text", lang_col="lang", usable=~la.held_out(docs["doc_id"]), sample_docs=la.SAMPLE_DOCS,
        sample_chars=la.SAMPLE_CHARS, most_labels=la.MOST_LABELS,
    )
    model = la.fit(texts, langs)
    gain = gain_by_force(model, texts, langs)
    # A limit that a text misses only by the field's weights, as far from all texts as can be: the hashed table differs a little from dictionaries.
    found = {r[0]: (g, model.spelling.gains(la.Features(words := _letters(r[1]), None)).sum() / words.length.sum()) for r in rows if (g := gain(r[1])) is not None}
    gains = sorted(g for g, _ in found.values())
    missed = lambda x: {k for k, (g, best) in found.items() if g < x <= best}
    gap, least = max((b - a, (a + b) / 2) for a, b in zip(gains, gains[1:]) if missed((a + b) / 2))
    kept = Counter(r.doc_id for r in la.accepted(docs.repartition(3), model, least=least).select("doc_id").collect())
    assert kept == Counter(r[0] for r in rows if (g := gain(r[1])) is not None and g >= least)
    assert 0 < sum(kept.values()) < len(rows) and not missed(least) & set(kept)


def test_the_field_decides_a_words_language(spark, model):
    docs = frame(spark, [(i, prose(i, 30, a), None, "s") for i, a in enumerate(ALPHABETS.values())])
    assert {r.doc_id for r in la.accepted(docs, model).collect()} == {0, 1, 2}
    # A field that takes every lower-case word for `xx`: words of other letters do not fit.
    table = model.table.copy()
    table[la._slot(np.zeros(1, np.uint64), 30)] = [100, 0, 0]
    forced = la.Model(model.labels, table, model.transitions, model.lexicon, model.spelling)
    assert {r.doc_id for r in la.accepted(docs, forced).collect()} == {0}


def test_without_labels_texts_without_a_letter_go(spark, tmp_path):
    rows = [(1, "abc", None, None), (2, None, None, "s"), (3, " \n", None, None), (4, "12 34 !!", None, None), (5, "12 é", None, None), (6, None, "xx", None)]
    kept = corpus_pipeline.language(spark, frame(spark, rows), str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {1, 5}
