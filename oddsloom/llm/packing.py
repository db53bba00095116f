"""Packing by power-of-two decomposition.

A document's ids are cut into as many pieces of the longest length as fit and one piece for each binary
digit of what is left. Every piece is a sequence of its own, so none crosses documents and none is padded;
pieces of equal length form a bucket, which a trainer batches together.

Nulls and empty texts are a document of the end id alone. Repeated rows are packed each. Other columns are
ignored. No rows: no pieces. Whole texts are encoded, however long; a batch holds few texts at a time.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from oddsloom.llm.words import once_per_worker

MAX_LENGTH = 1024
END_ID = 0
#: How a byte-level BPE splits text into pieces (a fixed value of these vocabularies).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters encoded at a time; a longer text is a batch of its own.
BATCH_CHARS = 1 << 18


def binary_lengths(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """`n` as a sum of powers of two, none above `longest` (itself one), in falling order."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << k for k in range(longest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _batches(texts: list[str | None]) -> Iterator[list[str]]:
    some, size = [], 0
    for t in texts:
        t = t or ""
        if some and size + len(t) > BATCH_CHARS:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(settings: dict) -> dict[bytes, int] | None:
    """The merge ranks of a plain byte-level BPE vocabulary whose ids are its ranks, else None."""
    model, split = settings["model"], settings["pre_tokenizer"] or {}
    plain = {"add_prefix_space": False, "use_regex": True}
    if model["type"] != "BPE" or settings["normalizer"] or split.get("type") != "ByteLevel" or any(split.get(k, v) != v for k, v in plain.items()):
        return None
    letters, added = _byte_letters(), {t["content"] for t in settings["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    in_order = [model["vocab"][m] for m in merged]
    return ranks if in_order == sorted(in_order) and len(ranks) == 256 + len(merged) else None


class Encoder:
    """Token ids of texts, as the tokenizer file gives them.

    A byte-level BPE file is also read as merge ranks, with which another library encodes several times faster and to
    the same ids. Texts that hold one of the file's added tokens always go to the file's own library."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        self.added = [t["content"] for t in settings["added_tokens"]]
        self.fast, ranks = None, _ranks(settings)
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def model(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, texts: list[str]) -> Iterator[list[int]]:
        for text in texts:
            if self.fast and not any(t in text for t in self.added):
                yield self.fast.encode_ordinary(text)
            else:
                yield self.model.encode(text, add_special_tokens=False).ids


def packer(tokenizer: str, longest: int, end_id: int, schema: pa.Schema):
    def pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = once_per_worker(f"encoder {tokenizer}", lambda: Encoder(tokenizer))
        for batch in batches:
            at = 0
            for texts in _batches(batch.column("text").to_pylist()):
                rows, starts, lengths, pieces, totals = [], [], [], [], []
                for found in encode(texts):
                    ids = np.array([*found, end_id], "<u4").tobytes()
                    start, n = 0, len(ids) // 4
                    for length in binary_lengths(n, longest):
                        rows.append(at)
                        starts.append(start)
                        lengths.append(length)
                        pieces.append(ids[4 * start : 4 * (start + length)])
                        totals.append(n)
                        start += length
                    at += 1
                columns = [batch.column("doc_id").take(pa.array(rows, pa.int64())), starts, lengths, pieces, totals]
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
                )

    return pack_batches


def pack(
    docs: DataFrame, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", longest: int = MAX_LENGTH, end_id: int = END_ID
) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, bucket, ids) per piece; `ids` are little-endian unsigned 32-bit.

    One narrow pass: no shuffle. Sequence ids follow the input's splits, which a rerun of a task repeats."""
    if longest & (longest - 1):
        raise ValueError("the longest length must be a power of two")
    kind = docs.schema[id_col].dataType
    schema = StructType([StructField("doc_id", kind), *(StructField(k, LongType()) for k in ("start", "length"))])
    schema = schema.add("ids", "binary").add("doc_tokens", "long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pieces = rows.mapInArrow(packer(tokenizer, longest, end_id, to_arrow_schema(schema)), schema)
    return pieces.select(
        F.col("doc_id").alias(id_col), "start", "length", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"), F.log2("length").cast("int").alias("bucket"), "ids",
    )
