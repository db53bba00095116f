"""Licence scans: TF-IDF cosine of notices, headers and licence files to templates, then inheritance by directory.

Units are every line, the runs of adjoining lines that begin at a paragraph or at a line with a telling word (see
`RUNS`), and every whole text. Word weights are ln(lines / lines with the word) + 1 over the whole corpus, for all
words. A unit reaches the threshold with a template only if it holds one of the words that carry more than 1 -
threshold ** 2 of the template's squared norm, its anchors; texts and units without any are left out. The others are
multiplied with the template vectors; those that would pass if their other words had the least weight there is get the
true norm in a join with the words' line counts. A file without a notice takes the licence of the nearest directory
above it that holds a licence file.

DataFrame functions only. The template table is a parameter, so the collected word counts and the broadcast
vectors have its size. Nulls: a null text has no notice; a null path has no directory. Ties: the first licence in
order; of several licence files in a directory the best score, then licence. Repeated rows count as lines of their
own and get equal results. Other columns are ignored. No rows: no rows.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.session import settle

THRESHOLD = 0.7
DIGITS = 9
#: File names that make a file a licence file whatever surrounds its notice.
FILE_NAMES = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"

#: (licence, notice) pairs; several notices of one licence are templates of their own.
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: Notices that span several lines in files, as one text each; a line break is a blank.
HEADERS = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-3-Clause", "All rights reserved. Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
#: Lines of a run; one that ends with its text may be shorter.
RUNS = (2, 3, 4, 6, 8, 12, 16, 24, 32, 48)


def licence_texts() -> tuple[tuple[str, str], ...]:
    """The full texts beside this module, named by licence."""
    return tuple((p.stem, p.read_text()) for p in sorted(Path(__file__).with_name("licence_texts").glob("*.txt")))


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def table_of(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A small table as one literal."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    cells = F.from_json(F.lit(text), "array<struct<" + ", ".join(c.replace(" ", ": ") for c in schema.split(", ")) + ">>")
    return spark.range(1).select(F.inline(cells))


def line_counts(lines: DataFrame) -> DataFrame:
    """(word, lines) for every word; the empty word has the lines with a word. `lines` has `unit`."""
    held = F.array_distinct(F.concat(F.array(F.lit("")), tokens(F.col("unit"))))
    held = lines.select(held.alias("held")).filter(F.size("held") > 1)
    return held.select(F.explode("held").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("lines"))


def template_vectors(templates: tuple, weight: dict[str, float]) -> list[tuple[int, str, str, float]]:
    """(template, licence, word, unit component) rows."""
    out = []
    for k, (licence, notice) in enumerate(templates):
        parts = {w: n * weight[w] for w, n in Counter(words_of(notice)).items()}
        norm = math.sqrt(sum(v * v for v in parts.values()))
        out += [(k, licence, w, v / norm) for w, v in parts.items()]
    return out


def anchors_of(vectors: list[tuple[int, str, str, float]], lines: dict[str, int], threshold: float) -> list[str]:
    """Words of which a unit needs one: without them less than threshold ** 2 of a template's squared norm is left."""
    by, out = defaultdict(list), set()
    for k, _, word, value in vectors:
        by[k].append((value * value / (1 + lines.get(word, 0)), word, value * value))
    for parts in by.values():
        mass = 0.0
        for _, word, square in sorted(parts, reverse=True):
            out.add(word)
            mass += square
            if mass > 1 - threshold * threshold + 1e-6:
                break
    return sorted(out)


def runs_of(lines: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(key, first, last, words) per line of each run of `lines` (key, no, words, telling, begins, n)."""
    most = max(lengths)
    begin = lines.filter((F.size("words") > 0) & (F.col("begins") | F.col("telling")))
    begin = begin.select("key", F.col("no").alias("first"), F.explode(F.array(F.floor(F.col("no") / most), F.floor(F.col("no") / most) + 1)).alias("part"))
    part = lines.select("key", "no", "words", "n", F.floor(F.col("no") / most).alias("part"))
    met = begin.join(part, ["key", "part"]).filter(F.col("no").between(F.col("first"), F.col("first") + most - 1))
    # Of the lengths that reach the end of the text only the first is a run of its own.
    ends = [F.when((F.col("first") + (lengths[i - 1] if i else 1) < F.col("n")) & (F.col("no") < F.col("first") + m), F.least(F.col("first") + m, F.col("n")) - 1) for i, m in enumerate(lengths)]
    return met.select("key", "first", F.explode(F.array_compact(F.array(*ends))).alias("last"), "words")


def matches(texts: DataFrame, counts: DataFrame, templates: tuple, threshold: float, lengths: tuple[int, ...] = RUNS) -> DataFrame:
    """(key, first, last, licence, score) of the units that reach the threshold, best licence each; a whole text
    has the lines -1 to -1. `texts` has (key, text), `counts` the lines of each word."""
    spark = texts.sparkSession
    vocabulary = sorted({w for _, notice in templates for w in words_of(notice)})
    known = dict(counts.filter(F.col("word").isin(["", *vocabulary])).collect())
    whole = 1 + known.get("", 0)
    weight = {w: math.log(whole / (1 + known.get(w, 0))) + 1 for w in vocabulary}
    cells = template_vectors(templates, weight)
    anchors = anchors_of(cells, known, threshold)
    telling = lambda t: F.exists(t, lambda w: w.isin(anchors))
    met = settle(texts.filter(telling(tokens(F.col("text")))).dropDuplicates(["key"]))
    split = F.split("text", "\n")
    lines = met.select("key", F.size(split).alias("n"), F.inline(F.transform(split, lambda x, i: F.struct(
        i.alias("no"), x.alias("unit"), F.coalesce(~F.get(split, i - 1).rlike("[A-Za-z0-9]"), F.lit(True)).alias("begins")))))
    lines = lines.select("key", "n", "no", "begins", tokens(F.col("unit")).alias("words"))
    lines = settle(lines.withColumn("telling", telling(F.col("words"))))
    units = lines.filter("telling").select("key", F.col("no").alias("first"), F.col("no").alias("last"), "words")
    units = units.union(runs_of(lines, lengths)).union(met.select("key", F.lit(-1).alias("first"), F.lit(-1).alias("last"), tokens(F.col("text"))))
    unit = ["key", "first", "last"]
    words = settle(units.select(*unit, F.explode("words").alias("word")).groupBy(*unit, "word").agg(F.count(F.lit(1)).alias("n")))
    weights = F.broadcast(table_of(spark, sorted(weight.items()), "word string, weight double"))
    vectors = F.broadcast(table_of(spark, cells, "template int, licence string, word string, value double"))
    weighed = words.join(weights, "word", "left")
    # No word weighs less than one.
    sums = weighed.groupBy(*unit).agg(
        F.coalesce(F.sum(F.pow(F.col("n") * F.col("weight"), F.lit(2))), F.lit(0.0)).alias("inner"),
        F.coalesce(F.sum(F.when(F.col("weight").isNull(), F.col("n") * F.col("n"))), F.lit(0)).alias("least"),
        F.max(F.col("word").isin(anchors)).alias("telling"),
    ).filter("telling")
    dots = words.join(weights, "word").join(vectors, "word").groupBy(*unit, "template", "licence").agg(F.sum(F.col("n") * F.col("weight") * F.col("value")).alias("dot"))
    near = dots.join(sums, unit).filter(F.col("dot") >= threshold * F.sqrt(F.col("inner") + F.col("least")) * (1 - 1e-9))
    near = settle(near.select(*unit, "licence", "dot", "inner", "least"))
    other = words.join(near.filter(F.col("least") > 0).select(*unit).distinct(), unit, "left_semi").join(weights, "word", "left_anti")
    idf = F.log(F.lit(float(whole)) / (1 + F.col("lines"))) + 1
    other = other.join(counts, "word").groupBy(*unit).agg(F.sum(F.pow(F.col("n") * idf, F.lit(2))).alias("outer"))
    scores = near.join(other, unit, "left").select(*unit, "licence", F.round(F.col("dot") / F.sqrt(F.col("inner") + F.coalesce("outer", F.lit(0.0))), DIGITS).alias("score"))
    return scores.filter(F.col("score") >= threshold).groupBy(*unit).agg(F.min(F.struct((-F.col("score")).alias("low"), "licence")).alias("best")).select(
        *unit, F.col("best.licence").alias("licence"), (-F.col("best.low")).alias("score")
    )


def notices(found: DataFrame) -> DataFrame:
    """(key, n_notices): matching lines and runs. A run counts if it scores above all its lines, once for runs that
    overlap; a line counts outside of such runs."""
    span = F.struct("first", "last", "score")
    spans = found.filter("first >= 0").groupBy("key").agg(
        F.array_compact(F.collect_list(F.when(F.col("first") == F.col("last"), span))).alias("single"),
        F.array_sort(F.array_compact(F.collect_list(F.when(F.col("first") < F.col("last"), span)))).alias("runs"),
    )
    within = lambda i, r: i["first"].between(r["first"], r["last"])
    spans = spans.withColumn("runs", F.filter("runs", lambda r: ~F.exists("single", lambda i: within(i, r) & (i["score"] >= r["score"]))))
    alone = F.filter("single", lambda i: ~F.exists("runs", lambda r: within(i, r)))
    start = F.struct(F.lit(-1).alias("reach"), F.lit(0).alias("n"))
    count = F.aggregate("runs", start, lambda a, r: F.struct(F.greatest(a["reach"], r["last"]).alias("reach"), (a["n"] + (r["first"] > a["reach"]).cast("int")).alias("n")))
    return spans.select("key", (F.size(alone) + count["n"]).alias("n_notices"))


def ancestors(path: Column) -> Column:
    """The directories above a path, from the root; the root is the empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def inherited(files: DataFrame, licence_files: DataFrame) -> DataFrame:
    """(key, licence, directory) of the nearest directory above each of `files` (key, path) with a licence file."""
    folders = licence_files.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("directory")).agg(
        F.min(F.struct((-F.col("score")).alias("low"), "licence")).alias("best")
    )
    above = files.filter(F.instr("path", "/") > 0).select("key", F.posexplode(ancestors(F.col("path"))).alias("depth", "directory"))
    near = above.join(folders, "directory").groupBy("key").agg(F.max(F.struct("depth", "directory", "best")).alias("near"))
    return near.select("key", F.col("near.best.licence").alias("from_licence"), F.col("near.directory").alias("from_directory"))


def scan_licences(
    files: DataFrame, *, id_col: str, text_col: str, path: Column, templates: tuple | None = None, threshold: float = THRESHOLD, file_names: str = FILE_NAMES
) -> DataFrame:
    """(id, path, n_notices, own_licence, own_score, is_licence_file, licence, from_directory) per row of `files`.

    Rows that share id, path and text share a key, and so their results."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = files.select(F.col(id_col).alias("id"), path.alias("path"), text.alias("text"))
    rows = rows.withColumn("key", F.xxhash64("id", "path", "text"))
    counts = settle(line_counts(rows.select(F.explode(F.split("text", "\n")).alias("unit"))))
    found = settle(matches(rows.select("key", "text"), counts, (*TEMPLATES, *HEADERS, *licence_texts()) if templates is None else templates, threshold))
    own = found.groupBy("key").agg(
        F.min(F.struct((-F.col("score")).alias("low"), "licence")).alias("best"), F.max(F.col("first") < 0).alias("whole"),
    ).join(notices(found), "key", "left")
    own = own.select("key", "n_notices", F.col("best.licence").alias("own_licence"), (-F.col("best.low")).alias("own_score"), "whole")
    thin = settle(rows.select("id", "path", "key").join(own, "key", "left"))
    named = F.coalesce(F.regexp_extract("path", "[^/]*$", 0).rlike(file_names), F.lit(False))
    is_file = F.col("own_licence").isNotNull() & (F.coalesce("whole", F.lit(False)) | named)
    sources = thin.filter(is_file).select("path", F.col("own_licence").alias("licence"), F.col("own_score").alias("score"))
    open_ = thin.filter("own_licence is null").select("key", "path").distinct()
    passed = inherited(open_, sources)
    return thin.join(passed, "key", "left").select(
        F.col("id").alias(id_col), "path", F.coalesce("n_notices", F.lit(0)).cast("bigint").alias("n_notices"), "own_licence", "own_score",
        is_file.alias("is_licence_file"), F.coalesce("own_licence", "from_licence").alias("licence"), "from_directory",
    )
