import re
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from oddsloom.llm import language as la
from oddsloom.llm.packing import binary_lengths
from oddsloom.llm.queries import QUERIES, tokenizer_path
from tests.llm.data import documents, frame
from tests.llm.test_dedup import classes_by_force
from tests.llm.test_switched import accepted_by_force
from tests.llm.test_texts import mix_by_force


def test_every_operator_has_one_query():
    assert Counter(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == Counter(range(1, 14))


def test_run_equals_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [r for r in documents() if r[0] is not None]
    frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    texts, langs = la.training_sample(
        docs, id_col="doc_id", text_col="text", lang_col="lang", usable=~la.held_out(docs["doc_id"]), sample_docs=la.SAMPLE_DOCS,
        sample_chars=la.SAMPLE_CHARS, most_labels=la.MOST_LABELS,
    )
    accept = accepted_by_force(texts, langs)
    left = [r for r in rows if accept(r[1])]
    assert {40, 41, 42, 45} <= {r[0] for r in rows} - {r[0] for r in left}
    assert {r[0] for r in rows if r[0] in (10, 20, 30, 50) or r[0] >= 100} <= {r[0] for r in left}
    seen, once = set(), []
    for r in sorted(left, key=lambda r: r[0]):
        if (norm := re.sub(r"[\x20\x09-\x0D]+", " ", r[1])) not in seen:
            seen.add(norm)
            once.append(r)
    classes = classes_by_force({r[0]: r[1] for r in once})
    apart = [r for r in once if classes[r[0]] == r[0]]
    assert len(apart) < len(once) < len(left)
    model = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r, (d, _, size, _, _, taken) in zip(apart, mix_by_force(apart)):
        ids, at = [*model.encode(r[1], add_special_tokens=False).ids, 0], 0
        for n in binary_lengths(len(ids)):
            want[d, at, n, np.array(ids[at : at + n], "<u4").tobytes()] += taken // size
            at += n
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.start, r.length, bytes(r.ids)) for r in found) == +want
    assert len({r.sequence_id for r in found}) == len(found)


def test_stages_keep_columns_and_take_empty_input(spark, tmp_path):
    docs = frame(spark, [])
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns and docs.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


def test_stages_take_nulls_and_repeats(spark, tmp_path):
    rows, kept = documents(), defaultdict(int)
    docs = frame(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.settle(stage(spark, docs, str(tmp_path)))
        kept[name] = docs.count()
    assert len(rows) >= kept["language"] > kept["exact_dedup"] > kept["near_dedup"] > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).select("doc_id").distinct().count() > 10
