"""Phrases whose words stand together more often than chance, by top-order marginalisation.

Every word of a piece of text opens one window of the longest order, made of lead columns and padded with null
behind the piece's end. Only these windows are counted. The count of a shorter phrase is the sum over the windows
it begins, so Spark's ROLLUP over (language, word 1, word 2, ...) sums them all; no shorter n-gram is ever spelled out.

Windows are nearly as many as words, so they travel packed: a task counts those of a stretch of text, sorts them by bucket
and language, and writes each bucket as one compressed block of lines. A bucket's blocks are added up where they meet, and
windows rarer than `min_count` lose their last word there, as do pairs: they cannot be phrases, and only their prefixes
still count. So ROLLUP gets little more than a row per word and per frequent phrase.

The bucket is told by the first word, so that its counts are complete in one place. Words that occur more than `HOT` times
are dealt by their first two words, and pairs that do by three. A first pass finds them by counting words and pairs in hashed
slots; slots shared by chance only deal more finely than needed, and pairs that are not complete in one place keep their words.

A candidate is cut after each of its words; the cut with the lowest score a * a / (l * r) decides. Products are
decimals of 38 digits. A candidate inside a longer phrase that accounts for `absorb` per cent of it is dropped.

The joins on parts of candidates have one row on one side; Spark splits a skewed other side. The last ranking keeps
`top` rows a language in each task first.

Nulls: a null text is empty; a null language is `und`, and so one with documents labelled so. Words are told by exact
text. Equal scores are ordered by count, then by the bytes of the phrase. Repeated rows count each time. Other
columns, and the document ids, are ignored. Texts without a repeated phrase, or no rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pv
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsloom.llm.words import mix64, span_hashes, text_slices, word_spans
from oddsloom.session import settle

LONGEST = 3
MIN_COUNT = 10
ABSORB = 50
TOP = 2000
SCALE = 1_000_000
#: Words of a bucket, and buckets at least.
BUCKET_WORDS, BUCKETS = 1 << 21, 64
#: Tasks that add up buckets.
MOST_TASKS = 1 << 15
#: Occurrences from which a word, or a pair, is dealt over many buckets.
HOT = 1 << 19
#: Slots in which words and pairs are counted to find those; a task leaves out slots it saw less often than this.
SLOT_BITS = 22
SEEN = 8
#: Bytes of text whose windows are counted together.
SLICE_BYTES = 1 << 23

#: Bytes that end a piece, and a word inside a piece; small letters of the ASCII capitals.
_BREAK, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP[[0x20, 0x09]] = True
_GAP |= _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _words(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(distinct words, word codes, language of each word, piece of each word, hash of each word with its language)."""
    langs = batch.column("lang").fill_null("und").dictionary_encode()
    codes, names = langs.indices.to_numpy(zero_copy_only=False), langs.dictionary
    for row, data, offsets in text_slices(batch.column("text"), SLICE_BYTES):
        data = _LOWER[data]
        starts, ends, before = word_spans(data, offsets, _GAP)
        if not len(starts):
            continue
        owner = np.repeat(np.arange(len(before) - 1), np.diff(before))
        # Both terms grow along the words; the sum changes where a break or a new text lies between two of them.
        piece = np.cumsum(_BREAK[data])[starts] + owner
        at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        flat = pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(data[~_GAP[data]])).dictionary_encode()
        lang = codes[row + owner]
        seeds = np.array([span_hashes(np.frombuffer(x, np.uint8), *np.array([[0], [len(x)]]))[0] for x in (str(n).encode() for n in names)], np.uint64)
        word = flat.indices.to_numpy(zero_copy_only=False)
        spelled = flat.dictionary
        edges = np.frombuffer(spelled.buffers()[1], np.int32)[: len(spelled) + 1].astype(np.int64)
        hashes = span_hashes(np.frombuffer(spelled.buffers()[2], np.uint8)[: edges[-1]], edges[:-1], edges[1:])
        yield spelled, word, lang, piece, mix64(hashes[word] + seeds[lang])


def _pairs(piece: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each word has a next one in its piece, and a hash of that pair."""
    paired = np.zeros(len(piece), bool)
    paired[:-1] = piece[1:] == piece[:-1]
    return paired, mix64(hashes * np.uint64(3) + np.roll(hashes, -1))


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


def _tally(seen_at_least: int):
    """(slot, n) of words and pairs that a task saw often enough; slot -1 has its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, words = np.zeros(1 << SLOT_BITS, np.int64), 0
        for batch in batches:
            for _, _, _, piece, hashes in _words(batch):
                paired, pair = _pairs(piece, hashes)
                words += len(hashes)
                for slots in (_slot(hashes), _slot(pair[paired])):
                    held, n = np.unique(slots, return_counts=True)
                    seen[held] += n
        held = np.flatnonzero(seen >= seen_at_least)
        slots, n = np.append(held, -1), np.append(seen[held], words)
        for k in range(0, len(slots), 1 << 14):
            yield pa.RecordBatch.from_arrays([pa.array(slots[k : k + (1 << 14)]), pa.array(n[k : k + (1 << 14)])], names=["slot", "n"])

    return run


def hot_slots(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Which slots hold more than `HOT` words or pairs, and how many words there are. The driver sees at most 2^22 numbers."""
    sums = texts.mapInArrow(_tally(SEEN), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    hot, words = np.zeros(1 << SLOT_BITS, bool), 0
    for slot, n in sums.filter((F.col("slot") < 0) | (F.col("n") > HOT)).collect():
        if slot < 0:
            words = n
        else:
            hot[slot] = True
    return hot, words


def _ahead(values: np.ndarray, k: int) -> np.ndarray:
    """The value `k` places on; zero behind the end."""
    return np.concatenate([values[k:], np.zeros(min(k, len(values)), values.dtype)])


def _starts(rows: np.ndarray) -> np.ndarray:
    """Where a column of an array differs from the one before."""
    return np.flatnonzero(np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)]))


def _summed(rows: np.ndarray, n: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct columns of an array, in order, and the sums of their `n`. All but the first row lie in [0, base)."""
    if (int(rows[0].max()) + 1) * base ** (len(rows) - 1) < 1 << 63:
        key = rows[0]
        for row in rows[1:]:
            key = key * base + row
        order = np.argsort(key)
    else:
        order = np.lexsort(rows[::-1])
    rows = rows[:, order]
    first = _starts(rows)
    return rows[:, first], np.add.reduceat(n[..., order], first, axis=-1)


def _dealt(hashes: np.ndarray, paired: np.ndarray, pair: np.ndarray, third: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each word's window: by one word, by two if that is hot, by three if the pair is.

    `third` has the hash of the third word where the window has one, else 0. Hot pairs lie in buckets of their own."""
    two = hot[_slot(hashes)] & paired
    three = two & hot[_slot(pair)]
    deal = np.where(three, mix64(pair * np.uint64(5) + third), np.where(two, pair, hashes))
    return (mix64(deal) % np.uint64(buckets)).astype(np.int64) + three * buckets


def _pack(longest: int, buckets: int, hot):
    """(bucket, lang, block): the windows of a slice with their number, as compressed lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            langs = batch.column("lang").fill_null("und").dictionary_encode().dictionary
            for spelled, word, lang, piece, hashes in _words(batch):
                paired, pair = _pairs(piece, hashes)
                # Word k of a window, counted from 1; 0 behind the end of the piece.
                columns, goes_on = [word + 1], np.ones(len(word), bool)
                for k in range(1, longest):
                    goes_on = goes_on & _ahead(paired, k - 1)
                    columns.append(np.where(goes_on, _ahead(word, k) + 1, 0))
                third = np.where(columns[2] > 0, _ahead(hashes, 2), np.uint64(0)) if longest > 2 else np.zeros(len(word), np.uint64)
                bucket = _dealt(hashes, paired, pair, third, hot.value, buckets)
                # Equal windows have equal buckets, so the sum over them is their number of times the bucket.
                told = np.stack([lang, *columns]).astype(np.int64)
                rows, both = _summed(told, np.stack([np.ones(len(word), np.int64), bucket]), len(spelled) + 1)
                n, key = both[0], both[1] // both[0]
                order = np.lexsort((rows[0], key))
                rows, n, key = rows[:, order], n[order], key[order]
                words = [spelled.take(pa.array(x - 1, pa.int64(), mask=x == 0)).fill_null("") for x in rows[1:]]
                lines = pc.binary_join_element_wise(*words, pc.cast(pa.array(n), pa.string()), " ")
                lines = pc.binary_join_element_wise(lines, "\n", "").cast(pa.large_string())
                edges, data = np.frombuffer(lines.buffers()[1], np.int64)[: len(n) + 1], lines.buffers()[2]
                first = _starts(np.stack([key, rows[0]]))
                cuts = [*edges[first], edges[-1]]
                blocks = [packer.compress(data.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:])]
                for k in range(0, len(first), 256):
                    at = first[k : k + 256]
                    columns_ = [pa.array(key[at].astype(np.int32)), langs.take(pa.array(rows[0, at])), pa.array(blocks[k : k + 256], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns_, names=["bucket", "lang", "block"])

    return run


def _unpack(longest: int, min_count: int, buckets: int):
    """The windows of each bucket and language, added up; what is too rare to be a phrase has lost its end."""
    names = _names(longest)
    form = pv.ParseOptions(delimiter=" ", quote_char=False, escape_char=False)
    types = pv.ConvertOptions(column_types={**dict.fromkeys(names, pa.string()), "n": pa.int64()}, strings_can_be_null=False)
    head = " ".join([*names, "n"]).encode() + b"\n"

    def added(blocks: list[bytes], bucket: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Words, windows as places in them (0 is no word), numbers."""
        opener = zstandard.ZstdDecompressor()
        text = head + b"".join(opener.decompress(b) for b in blocks)
        table = pv.read_csv(pa.py_buffer(text), pv.ReadOptions(use_threads=False, block_size=max(1 << 20, len(text))), form, types)
        flat = pa.chunked_array([pa.array([""]), *[c for name in names for c in table[name].chunks]]).combine_chunks().dictionary_encode()
        rows, base = flat.indices.to_numpy(zero_copy_only=False)[1:].astype(np.int64).reshape(longest, -1), len(flat.dictionary)
        rows, n = _summed(rows, table["n"].to_numpy(), base)
        for k in range(longest, 1, -1):
            # A prefix of k words is complete here, but for pairs that were dealt by three.
            if k > 2 or bucket < buckets:
                first = _starts(rows[:k])
                rare = np.repeat(np.add.reduceat(n, first) < min_count, np.diff(np.append(first, len(n))))
                rows[k - 1 :, rare] = 0
                rows, n = _summed(rows, n, base)
        return flat.dictionary, rows, n

    def told(bucket: int, lang: str, blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        spelled, rows, n = added(blocks, bucket)
        for a in range(0, len(n), 1 << 14):
            part = rows[:, a : a + (1 << 14)]
            leads = [spelled.take(pa.array(x, mask=x == 0)) for x in part]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * part.shape[1], pa.string()), *leads, pa.array(n[a : a + (1 << 14)])], names=["lang", *names, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((*key, block) for batch in batches for *key, block in zip(*(batch.column(c).to_pylist() for c in ("bucket", "lang", "block")), strict=True))
        for (bucket, lang), group in groupby(rows, key=lambda r: r[:2]):
            yield from told(bucket, lang, [r[2] for r in group])

    return run


def _names(longest: int) -> list[str]:
    return [f"w{k + 1}" for k in range(longest)]


def windows(docs: DataFrame, longest: int, min_count: int, *, text_col: str, lang_col: str) -> DataFrame:
    """(lang, w1, ..., w`longest`, n): windows and their number. What is rarer than `min_count` may have lost its end; some rows agree."""
    texts = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    hot, words = hot_slots(texts)
    buckets = max(BUCKETS, words // BUCKET_WORDS)
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    packed = texts.mapInArrow(_pack(longest, buckets, shared), "bucket int, lang string, block binary")
    met = packed.repartition(min(buckets, MOST_TASKS), "bucket").sortWithinPartitions("bucket", "lang")
    schema = ", ".join(["lang string", *[f"{w} string" for w in _names(longest)], "n bigint"])
    return met.mapInArrow(_unpack(longest, min_count, buckets), schema)


def phrase_counts(docs: DataFrame, *, longest: int = LONGEST, min_count: int = MIN_COUNT, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, words, f) of every phrase of up to `longest` words seen `min_count` times, and of every language's empty phrase.

    The empty phrase counts all word occurrences."""
    names = _names(longest)
    top = windows(docs, longest, min_count, text_col=text_col, lang_col=lang_col)
    sums = top.rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
    # Level 2^k - 1 has summed the last k words away; what is left must be unpadded.
    known = F.lit(False)
    for k in range(longest):
        known |= (F.col("level") == (1 << k) - 1) & F.col(names[-1 - k]).isNotNull() & (F.col("f") >= min_count)
    known |= F.col("level") == (1 << longest) - 1
    return sums.filter(known).select("lang", F.array_compact(F.array(*names)).alias("words"), "f")


def exact_score(a: Column, first: Column, rest: Column, scale: int = SCALE) -> Column:
    """floor(scale * a * a / (first * rest)) in decimals, for counts below 10^15 with a quotient in 64 bits."""
    wide = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", (wide(a) * wide(a) * F.lit(scale).cast("decimal(7,0)")).cast("decimal(38,0)"), wide(first) * wide(rest))


def collocations(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, min_count: int = MIN_COUNT,
    absorb: int = ABSORB, top: int | None = TOP,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` best phrases of two words or more; None ranks all."""
    counts = settle(phrase_counts(docs, longest=longest, min_count=min_count, text_col=text_col, lang_col=lang_col))
    known = counts.filter(F.size("words") > 0).select("lang", F.concat_ws(" ", "words").alias("part"), "f")
    found = counts.filter(F.size("words") > 1).select("lang", "words", F.concat_ws(" ", "words").alias("phrase"), F.col("f").alias("a"))
    # Longer phrases hand their count to the phrases inside them.
    inner = found.filter(F.size("words") > 2).select("lang", "a", "words", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("m"))
    inner = inner.select("lang", "a", "words", "m", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("m") + 1)).alias("at"))
    longer = inner.groupBy("lang", F.concat_ws(" ", F.slice("words", F.col("at"), F.col("m"))).alias("phrase")).agg(F.max("a").alias("longer"))
    alone = found.join(longer, ["lang", "phrase"], "left").filter(~F.coalesce(100 * F.col("longer") >= absorb * F.col("a"), F.lit(False)))
    cuts = alone.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", F.concat_ws(" ", F.slice("words", F.lit(1), F.col("k"))).alias("first"),
        F.concat_ws(" ", F.slice("words", F.col("k") + 1, F.size("words"))).alias("rest"),
    )
    cuts = cuts.join(known.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    scored = cuts.withColumn("score", exact_score(F.col("a"), F.col("l"), F.col("r")))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut")).select("lang", "phrase", "cut.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = lowest.withColumn("rank", F.row_number().over(order).cast("bigint"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    sizes = counts.filter(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
