import math
import re
import textwrap
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from oddsloom.llm import licences as li
from tests.llm.data import prose

COMMON = Path("/usr/share/common-licenses")
REAL = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}


def table(spark, texts: list[str]):
    return spark.createDataFrame([(i, t, f"/d{i}/x{i}.c") for i, t in enumerate(texts)], "doc_id long, text string, path string")


def scan(spark, texts: list[str]) -> dict:
    found = li.scan_licences(table(spark, texts), id_col="doc_id", text_col="text", path=F.col("path")).collect()
    assert len(found) == len(texts)
    return {r.doc_id: r for r in found}


@pytest.mark.skipif(not COMMON.is_dir(), reason="no licence files on this machine")
def test_real_licence_files_and_wrapped_headers(spark):
    files = [(COMMON / n).read_text() for n in REAL]
    files += ["MIT License\n\nCopyright (c) 2021 Jo Doe\n\n" + dict(li.licence_texts())["MIT"].replace("\n", "\r\n")]
    wanted = [*REAL.values(), "MIT"]
    headers = [(lic, width, mark) for lic, _ in li.HEADERS for width, mark in ((45, "# "), (72, " * "))]
    wrapped = ["\n".join(mark + line for line in textwrap.wrap(dict(li.HEADERS)[lic], width)) for lic, width, mark in headers]
    bodies = [prose(i, 200).replace(" ", "\n", 30) for i in range(len(wrapped))]
    texts = files + [f"#!/bin/sh\n# Copyright 2020 Jo Doe\n{w}\n\n{b}" for w, b in zip(wrapped, bodies)]
    # A header in the middle of a text, and two of them.
    texts += [f"{bodies[0]}\n\n{wrapped[2]}\n\n{bodies[1]}", f"{wrapped[2]}\n\n{bodies[0]}\n\n{wrapped[-1]}\n{bodies[1]}"]
    texts += [prose(500 + i, 60) for i in range(100)]
    found = scan(spark, texts)
    assert [(found[i].own_licence, found[i].is_licence_file) for i in range(len(files))] == [(w, True) for w in wanted]
    at = len(files)
    assert [found[at + i].own_licence for i in range(len(headers))] == [lic for lic, *_ in headers]
    assert not any(found[at + i].is_licence_file for i in range(len(headers)))
    assert found[at + len(headers)].own_licence == headers[2][0] and found[at + len(headers) + 1].n_notices == 2
    assert all(found[i].own_licence is None and found[i].n_notices == 0 for i in range(at + len(headers) + 2, len(texts)))


def test_every_word_has_the_weight_of_its_line_count(spark):
    notice = "Use of this source code is governed by a BSD-style license that can be"
    crowd = [f"it can be that {prose(i, 3)}" for i in range(400)]
    texts = [notice, *crowd, *(f"Licensed under the Apache License, Version 2.0. {prose(900 + i, 2)}" for i in range(50))]
    got = scan(spark, texts)[0]
    words = lambda t: [w for w in re.split("[^a-z0-9]+", t.lower()) if w]
    held = Counter(w for t in texts for w in set(words(t)))
    idf = lambda w: math.log((1 + len(texts)) / (1 + held[w])) + 1
    vector = lambda t: {w: n * idf(w) for w, n in Counter(words(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    unit, best = vector(notice), 0
    for licence, text in (*li.TEMPLATES, *li.HEADERS, *li.licence_texts()):
        other = vector(text)
        best = max(best, sum(x * other.get(w, 0) for w, x in unit.items()) / norm(unit) / norm(other))
    assert got.own_licence == "BSD-3-Clause" and math.isclose(got.own_score, best, abs_tol=2e-9)


def test_common_words_do_not_push_a_notice_out(spark):
    notice = "Use of this source code is governed by a BSD-style license that can be"
    crowd = [f"that can be {prose(i, 4)}" for i in range(300)]
    more = [f"that can be {prose(2_000 + i, 4)}" for i in range(600)] + ["Use of this source code is governed by a BSD-style license."] * 100
    alone, among = scan(spark, [notice, *crowd])[0].own_score, scan(spark, [notice, *crowd, *more])[0].own_score
    assert alone >= li.THRESHOLD and among >= li.THRESHOLD
