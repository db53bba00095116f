import base64
import random
import string
from collections import Counter
from math import log

import numpy as np

import corpus_pipeline
from oddsloom.llm import language as la
from tests.llm.data import frame, prose

ALPHABETS = {"xx": "abcdefg", "yy": "hijklmn", "zz": "opqrstu"}


def _words(text):
    found, word = [], ""
    for c in [*(text or ""), " "]:
        if c.isalpha():
            word += c.lower() if len(c.lower()) == 1 else c
        elif word:
            found.append(word)
            word = ""
    return found


def gain_by_force(texts, langs):
    """Nats a letter by which a text is likelier in learned languages than by single letters; dictionaries, word by word."""
    grams = {lang: Counter() for lang in langs}
    for text, lang in zip(texts, langs):
        for w in _words(text):
            grams[lang].update(w[i : i + k] for k in (1, 2, 3) for i in range(len(w) - k + 1))
    letters = Counter()
    for c in grams.values():
        letters.update({g: n for g, n in c.items() if len(g) == 1})
    whole, back = sum(letters.values()), la.BACK_OFF
    totals = {lang: sum(n for g, n in c.items() if len(g) == 1) for lang, c in grams.items()}

    def likely(w, lang):
        c = grams[lang]
        one = lambda x: (1 - la.UNSEEN_IN_LANGUAGE) * c[x] / totals[lang] + la.UNSEEN_IN_LANGUAGE
        two = lambda x: (c[x] + back * one(x[1])) / (c[x[0]] + back)
        three = lambda x: (c[x] + back * two(x[1:])) / (c[x[:2]] + back)
        return log(one(w[0])) + (log(two(w[:2])) if len(w) > 1 else 0) + sum(log(three(w[i : i + 3])) for i in range(len(w) - 2))

    def plain(w):
        return sum(log((1 - la.UNSEEN) * letters[x] / whole + la.UNSEEN / (len(letters) + 1)) for x in w)

    def gain(text):
        words = _words(text)
        return sum(max(likely(w, lang) for lang in grams) - plain(w) for w in words) / sum(map(len, words)) if words else None

    return gain


def accepted_by_force(texts, langs):
    gain = gain_by_force(texts, langs)
    return lambda text: (g := gain(text)) is not None and g >= la.LEAST_GAIN


def _learned():
    return [(i, prose(i, 40, ALPHABETS[lang]), lang, "s") for i in range(90) for lang in [("xx", "yy", "zz")[i % 3]]]


def test_gain_equals_dictionaries():
    rows = _learned()
    texts, langs = [r[1] for r in rows], [r[2] for r in rows]
    model, gain = la.fit(texts, langs, epochs=1), gain_by_force(texts, langs)
    for text in ["bad cafe hijk mnlo", "a", "aé zebra Quiz", "ÄB中文 stop", texts[3]]:
        raw = text.encode()
        words = la.Letters.of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert np.isclose(model.spelling.gains(la.Features(words, None)).sum() / words.length.sum(), gain(text), rtol=1e-5)


def test_stage_drops_junk_and_keeps_switched_texts(spark, tmp_path):
    r = random.Random(5)
    # Real words have a shape: syllables of the language's letters.
    shaped = {lang: [a + b for a in letters[:3] for b in letters[3:]] for lang, letters in ALPHABETS.items()}
    speak = lambda lang, seed, n: " ".join("".join(random.Random(seed * 1000 + i).choices(shaped[lang], k=3)) for i in range(n))
    clean = [(i, speak(lang, i, 40), lang, "s") for i in range(150) for lang in [("xx", "yy", "zz")[i % 3]]]
    switched = (1000, "\n".join(speak(lang, 1000 + i, 60) for i, lang in enumerate(ALPHABETS)), None, "s")
    short = (1001, speak("xx", 77, 2), None, None)
    junk = [
        "12 34 !!", None, " ", " ".join("".join(r.choice(string.ascii_lowercase) for _ in range(7)) for _ in range(80)), base64.b64encode(r.randbytes(300)).decode(),
        "Η ταχεία αλεπού πηδά πάνω", "Zażółć gęślą jaźń", "敏捷的棕色狐狸跳过了懒狗", "<div><span></span></div>" * 4,
    ]
    frame(spark, [*clean, switched, short, *[(2000 + i, t, None, "s") for i, t in enumerate(junk)]]).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, str(tmp_path)).select("doc_id").collect()}
    assert kept == {r[0] for r in clean} | {1000, 1001}


def test_pipeline_keeps_a_document_in_three_languages(spark, tmp_path):
    rows = _learned()
    rows += [(1000, "\n".join(prose(1000 + i, 60, a) for i, a in enumerate(ALPHABETS.values())), None, "s"), (1001, "12 34 !!", None, "s")]
    frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, str(tmp_path)).select("doc_id").collect()}
    assert kept == {r[0] for r in rows} - {1001}
    # The later stages see it.
    assert corpus_pipeline.exact(spark, docs.filter("doc_id = 1000"), str(tmp_path)).count() == 1


def test_labels_beyond_the_bound_are_not_learned(spark):
    rows = [*_learned(), *[(500 + i, prose(500 + i, 20), f"l{i}", "s") for i in range(40)]]
    model = la.train(frame(spark, rows), most_labels=3)
    assert model.labels == ["xx", "yy", "zz"]
    assert {r.lang_pred for r in la.predict(frame(spark, rows), model).collect()} == {"xx", "yy", "zz"}
