"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructType

#: Names the operators use inside; a table may have them as extra columns.
CLASH = ("id", "h", "key", "row", "g", "s", "size", "band", "digest", "keep_id", "copies", "label_", "path_", "norm", "value")

DOCS = StructType().add("doc_id", LongType()).add("text", StringType()).add("lang", StringType()).add("source", StringType()).add("n_chars", LongType())
for _name in CLASH:
    DOCS = DOCS.add(_name, StringType())
PAGES = StructType().add("page_id", LongType()).add("url", StringType()).add("html", StringType()).add("digest", StringType()).add("head", StringType())
VECTORS = StructType().add("vec_id", LongType()).add("embedding", ArrayType(DoubleType())).add("label", IntegerType()).add("rep", StringType()).add("n", LongType())


def prose(seed: int, words: int, alphabet: str = "abcdefghij") -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(2, 8))) for _ in range(words))


def edited(text: str, seed: int, changes: int) -> str:
    r, words = random.Random(seed), text.split(" ")
    for i in r.sample(range(len(words)), changes):
        words[i] = f"new{r.randint(0, 10**6)}"
    return " ".join(words)


def documents() -> list[tuple]:
    """(doc_id, text, lang, source) rows."""
    a, b, c = prose(1, 120), prose(2, 300, "klmnopqrst"), prose(3, 90, "uvwxyzabcd")
    rows = [
        (10, a, "xx", "s1"), (4, a.replace(" ", "  \n", 3), "xx", "s1"), (11, edited(a, 5, 2), "xx", None), (12, edited(a, 6, 40), "xx", "s2"),
        (20, b, "yy", "s2"), (21, edited(b, 7, 5), "yy", "s1"), (22, b, "yy", "s1"), (22, b, "yy", "s1"),
        (30, c, None, "s3"), (31, prose(4, 40) + " " + c[:260] + " " + prose(5, 30), "xx", "s3"),
        (40, None, "xx", "s1"), (41, "", "yy", None), (42, " \t\n", None, "s2"), (43, "one two three", "xx", "s1"), (44, "one two three", "xx", "s2"),
        (45, "12 34 !!", None, None), (46, "ünï cödé ß 中文 😀", "yy", "s1"), (None, "no id here at all " + prose(6, 20), "xx", "s1"),
        (50, prose(7, 9_000), "xx", "s1"), (51, "z" * 3_000, "yy", "s3"), (52, "ab " * 900, None, "s3"),
        (60, "mail bob.x@mail.example.com or +49 (30) 1234-5678, 10.0.0.255, 4111 1111 1111 1111 " + prose(8, 12), "xx", "s2"),
        (61, "again bob.x@mail.example.com zyzzyva " + prose(9, 12), "xx", "s2"), (62, "once more Bob.X@mail.example.com zyzzyva", "xx", "s2"),
        (63, "Licensed under the Apache License, Version 2.0.\n" + prose(10, 30), "xx", "s1"), (64, "Released under the MIT License.", "xx", "s1"),
    ]
    return rows + [(100 + i, prose(100 + i, 60, "abcdefghij" if i % 2 else "klmnopqrst"), "xx" if i % 2 else "yy", f"s{i % 3}") for i in range(40)]


def frame(spark, rows: list[tuple]):
    """Rows as a table like `documents`, with extra columns of clashing names."""
    extra = tuple(f"{n}!" for n in CLASH)
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *extra) for r in rows], DOCS)
