"""Personal data in texts, and the words around it that give it away.

Base spans are matches of four patterns. The information-theoretic step asks which other words reveal an entity
(a base value that several documents hold): over the whole corpus, a word that stands in at least `SUPPORT` documents
of an entity, anywhere in their texts, discloses it when their pointwise mutual information reaches the share `ALPHA`
of the entity's information content, PMI(t, e) >= ALPHA * IC(e), that is P(e | t) >= P(e) ** (1 - ALPHA). Wherever
such a word stands, also in documents that lack the entity, it is generalised to its stem of `STEM` letters if the stem
does not disclose the entity, and removed otherwise. Document counts of words cover all documents; only words that can
matter are counted, picked by a bitmap of fixed size and then exactly, and so are the places of disclosing words.

Nulls: a null text is empty; a null id is kept. Repeated rows count as documents and get equal spans. Other
columns are ignored. No rows: no rows. Digit runs of any length are read whole, in linear time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructType

from oddsloom.llm.common import bitmap, in_bitmap, screened
from oddsloom.llm.language import Letters
from oddsloom.llm.words import text_slices
from oddsloom.session import settle

ALPHA = 0.9
SUPPORT = 2
STEM = 4
#: Bits of the word screen: 8 MB, whatever the number of words.
SCREEN_BITS = 1 << 26
SLICE_BYTES = 1 << 19
KINDS = ("email", "ip", "card", "phone")
ADDED = ("general", "remove")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

_BASE = (
    StructType().add("id", "long").add("h", "long").add("n_email", "long").add("n_ip", "long").add("n_card", "long").add("n_phone", "long")
    .add("base", "string").add("entities", ArrayType(LongType()))
)
_HELD = StructType().add("id", "long").add("h", "long").add("entity", "long").add("term", "long").add("stem", "long")
_PLACE = StructType().add("id", "long").add("h", "long").add("term", "long").add("start", "long").add("end", "long")
_COUNT = StructType().add("term", "long").add("docs", "long")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each match has one @: the local part runs back from it, no further than the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Groups of four numbers of a dotted run, from its left."""
    for run in _DOTTED.finditer(text):
        parts, at = run.group().split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(2 * v - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            yield m.span()


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    return [(kind, a, b) for kind, find in FINDERS.items() for a, b in find(text)]


def entity_hash(kind: str, value: str) -> int:
    """A value as its documents share it: e-mail in lower case, numbers as digits."""
    plain = value.lower() if kind in ("email", "ip") else _NOT_DIGIT.sub("", value)
    return int.from_bytes(hashlib.blake2b(f"{kind}:{plain}".encode(), digest_size=8).digest(), "little", signed=True)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _base(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, hashes = batch.column("text"), batch.column("id").to_pylist(), batch.column("h").to_pylist()
            rows = []
            for row, data, offsets in text_slices(texts):
                # Every pattern needs a digit or an @; texts without either are not decoded at all.
                marks = np.concatenate([[0], np.cumsum(((data >= 48) & (data <= 57)) | (data == 64))])
                for i in range(len(offsets) - 1):
                    spans, found = [], []
                    if marks[offsets[i + 1]] > marks[offsets[i]]:
                        text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
                        spans = base_spans(text)
                        found = sorted({entity_hash(k, text[a:b]) for k, a, b in spans})
                    counts = [sum(k == kind for k, _, _ in spans) for kind in KINDS]
                    rows.append((ids[row + i], hashes[row + i], *counts, joined(spans), found))
            if rows:
                yield _batch(rows, schema)

    return run


def terms_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and stem hash of each word of a text, where it starts and ends."""
    raw = np.frombuffer(text.encode(), np.uint8)
    words = Letters.of(raw, np.array([0, len(raw)], np.int64))
    return *_hashes(words), words.at, words.at + words.length


def _hashes(words: Letters) -> tuple[np.ndarray, np.ndarray]:
    """Words and stems share one space of hashes; a word no longer than the stem has none (0)."""
    stems = words.hashes(STEM) ^ np.uint64(0x5DEECE66D)
    return words.hashes().view(np.int64), np.where(words.length > STEM, stems, 0).astype(np.uint64).view(np.int64)


def _free(text: str, spans: list[tuple[str, int, int]]) -> tuple[np.ndarray, ...]:
    """`terms_of` a text outside its base spans."""
    term, stem, start, end = terms_of(text)
    free = np.ones(len(term), bool)
    for _, a, b in spans:
        free[np.searchsorted(end, a, "right") : np.searchsorted(start, b)] = False
    return tuple(x[free] for x in (term, stem, start, end))


def _held(schema: pa.Schema):
    """The different words of each text with each of its entities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, h, text in zip(*(batch.column(k).to_pylist() for k in ("id", "h", "text")), strict=True):
                spans = base_spans(text or "")
                term, stem, _, _ = _free(text or "", spans)
                term, first = np.unique(term, return_index=True)
                for entity in sorted({entity_hash(k, text[a:b]) for k, a, b in spans}) if len(term) else ():
                    same = [pa.array([v] * len(term), pa.int64()) for v in (id_, h, entity)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(term), pa.array(stem[first])], schema=schema)

    return run


def _places(screen, schema: pa.Schema):
    """Where words of the screen stand, outside base spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(screen.value, np.uint8)
        for batch in batches:
            ids, hashes = batch.column("id").to_pylist(), batch.column("h").to_pylist()
            for row, data, offsets in text_slices(batch.column("text"), SLICE_BYTES):
                words = Letters.of(data, offsets)
                hit = in_bitmap(_hashes(words)[0], bits)
                for i in np.unique(np.searchsorted(words.before, np.flatnonzero(hit), "right") - 1):
                    text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
                    term, _, start, end = _free(text, base_spans(text))
                    on = in_bitmap(term, bits)
                    same = [pa.array([v] * int(on.sum()), pa.int64()) for v in (ids[row + i], hashes[row + i])]
                    yield pa.RecordBatch.from_arrays([*same, *(pa.array(x[on], pa.int64()) for x in (term, start, end))], schema=schema)

    return run


def _document_counts(screen, schema: pa.Schema):
    """Documents of each screened word or stem, summed over a slice of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(screen.value, np.uint8)
        for batch in batches:
            for _, data, offsets in text_slices(batch.column("text"), SLICE_BYTES):
                words = Letters.of(data, offsets)
                text = np.repeat(np.arange(len(offsets) - 1), np.diff(words.before))
                found = []
                for value in _hashes(words):
                    hit = in_bitmap(value, bits)
                    found.append(np.stack([value[hit], text[hit]]))
                pairs = np.unique(np.concatenate(found, axis=1), axis=1)
                if pairs.shape[1]:
                    terms, docs = np.unique(pairs[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(docs)], schema=schema)

    return run


def disclosing(seen: DataFrame, texts: DataFrame, entity_docs: DataFrame, documents: int, *, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """(entity, term, action) of the words to generalise or remove; `seen` has a row per document, entity and word."""
    joint = settle(seen.groupBy("entity", "term", "stem").agg(F.sum("copies").alias("joint")).filter(F.col("joint") >= support))
    stems = seen.filter("stem <> 0").join(joint.select("entity", "stem").distinct(), ["entity", "stem"], "left_semi")
    stems = stems.select("entity", "stem", "id", "h", "copies").distinct().groupBy("entity", "stem").agg(F.sum("copies").alias("stem_joint"))
    wanted = settle(joint.select("term").union(joint.filter("stem <> 0").select("stem")).distinct())
    screen = texts.sparkSession.sparkContext.broadcast(bitmap(wanted, "term", SCREEN_BITS))
    counts = texts.select("text").mapInArrow(_document_counts(screen, to_arrow_schema(_COUNT)), _COUNT)
    # Not a semi-join, which would be moved ahead of the sum and meet a row per slice of texts.
    counts = settle(counts.groupBy("term").agg(F.sum("docs").alias("docs")).join(wanted, "term"))
    limit = F.pow(F.col("entity_docs") / float(max(documents, 1)), F.lit(1 - alpha))
    bad = (
        joint.join(entity_docs, "entity").join(counts, "term").filter(F.col("joint") / F.col("docs") >= limit)
        .select("entity", "term", "stem", "entity_docs")
    )
    wide = counts.select(F.col("term").alias("stem"), F.col("docs").alias("stem_docs"))
    told = bad.join(stems, ["entity", "stem"], "left").join(wide, "stem", "left")
    open_ = F.col("stem_joint") / F.col("stem_docs") < limit
    return told.select("entity", "term", F.when(F.coalesce(open_, F.lit(False)), ADDED[0]).otherwise(ADDED[1]).alias("action"))


def find_private(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, support: int = SUPPORT
) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per row of `docs`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    rows = settle(texts.mapInArrow(_base(to_arrow_schema(_BASE)), _BASE))
    documents = rows.count()
    held = rows.filter(F.size("entities") > 0).groupBy("id", "h").agg(F.count(F.lit(1)).alias("copies"), F.first("entities").alias("entities"))
    held = settle(held.select("id", "h", "copies", F.explode("entities").alias("entity")))
    entity_docs = settle(held.groupBy("entity").agg(F.sum("copies").alias("entity_docs")).filter(F.col("entity_docs") >= support))
    shared = held.join(entity_docs, "entity", "left_semi")
    where = settle(shared.select("id", "h", "copies").distinct())
    # Texts that hold a shared entity; a text that several rows share under one id is read once.
    met = screened(texts, F.col("h"), where, "h").dropDuplicates(["id", "h"])
    seen = met.mapInArrow(_held(to_arrow_schema(_HELD)), _HELD)
    on = seen["id"].eqNullSafe(where["id"]) & (seen["h"] == where["h"])
    seen = seen.join(where, on, "left_outer").select(seen["*"], "copies").filter("copies is not null")
    seen = settle(seen.join(entity_docs.select("entity"), "entity", "left_semi"))
    bad = disclosing(seen, texts, entity_docs, documents, alpha=alpha, support=support)
    # A word of several entities is removed if one of them asks for it.
    told = settle(bad.groupBy("term").agg(F.max("action").alias("action")))
    screen = docs.sparkSession.sparkContext.broadcast(bitmap(told, "term", SCREEN_BITS))
    marks = texts.mapInArrow(_places(screen, to_arrow_schema(_PLACE)), _PLACE).join(told, "term")
    marks = marks.select("id", "h", "start", "end", "action").distinct()
    lists = marks.groupBy("id", "h").agg(F.sort_array(F.collect_list(F.struct("action", "start", "end"))).alias("marks"))
    more = lists.select(
        F.col("id").alias("m_id"), F.col("h").alias("m_h"), F.array_join(F.transform("marks", lambda m: F.concat_ws(":", m["action"], m["start"], m["end"])), ",").alias("more")
    )
    return rows.join(more, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("h") == F.col("m_h")), "left").select(
        F.col("id").alias(id_col), "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"),
        F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), "more").alias("spans"), F.col("h").alias("text_hash"),
    )


def sanitised_text(text: str, spans: str) -> str:
    """`text` with its spans replaced: base values by their kind, words by their stem or a mark."""
    out, at = [], 0
    marks = sorted(((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)), key=lambda m: (m[0], -m[1]))
    for a, b, kind in marks:
        if a < at:
            at = max(at, b)
            continue
        out += [text[at:a], f"{text[a : a + STEM]}*" if kind == ADDED[0] else "[REMOVED]" if kind == ADDED[1] else f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """`docs` with their texts sanitised; null texts stay null."""
    spans = find_private(docs, id_col=id_col, text_col=text_col, **settings)
    spans = spans.filter("spans <> ''").select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__h"), F.col("spans").alias("__spans")).distinct()
    keyed = docs.withColumn("__key", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    met = keyed.join(spans, keyed[id_col].eqNullSafe(spans["__id"]) & (keyed["__key"] == spans["__h"]), "left")
    clean = F.pandas_udf(lambda t, s: t.combine(s, lambda x, y: x if x is None or not y else sanitised_text(x, y)), "string")
    return met.withColumn(text_col, F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(clean(F.col(text_col), F.col("__spans")))).select(*docs.columns)
