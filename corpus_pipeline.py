"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again for the next.
All but the last return the columns of `documents`. Every stage works on all rows its predecessor kept.

Null or empty texts, and texts without a letter, go in the first stage; other nulls are no reason to drop a row. Rows without id are
never near duplicates of anything, and mixing tells them apart by text. An id may repeat: equal rows stay together, and rows that
share an id with different texts are judged by their own text. Ties go to the smallest id. Texts are whole however long they
are. Extra columns, whatever their names, are carried to mixing. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oddsloom.llm.common import LlmQuery, read, small_batches
from oddsloom.llm.exact_dedup import halves, keep_first
from oddsloom.llm.language import accepted, train
from oddsloom.llm.minhash import drop_near_duplicates
from oddsloom.llm.mixing import mixed
from oddsloom.llm.packing import pack
from oddsloom.llm.queries import tokenizer_path
from oddsloom.session import prepare, settle


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, or in none of the learned languages. Without labels there are no others to reject."""
    small_batches(spark)
    return accepted(docs, train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text up to white space, keep the smallest id."""
    return keep_first(docs, in_snapshot=halves(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate documents, keep the smallest id."""
    small_batches(spark)
    return drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents as often as their source's target asks for; a document taken twice is two rows."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length, each a sequence; `ids` are little-endian unsigned 32-bit."""
    small_batches(spark)
    return pack(docs, tokenizer=tokenizer_path())


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixture), ("packing", packing)]

#: Language ID, signatures and tokens have no SQL equivalent; tests compare `run` with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, written between stages so that a lost executor repeats one stage only."""
    docs = read(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settle(docs)
    return docs


QUERY = LlmQuery(run, ORACLE_SQL)
