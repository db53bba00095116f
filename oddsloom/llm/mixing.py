"""Mixing sources to target weights by hash-threshold histograms.

Words are summed by source and hash bucket. Each source's target is so many whole passes over it and a
rest; the rest is a hash threshold, found by nested histograms: the bucket in which the running sum meets
the rest is the only one that is split further. The choice is then a filter on the hash: nothing is sorted
or sampled, larger budgets contain smaller ones, and reruns agree.

Where several rows share an id, or have none, the hash is taken of the id, the text and a number that tells equal rows of
a source apart, so that such rows too are taken one by one.

Nulls: a null text has no words; a null source is a source of its own, last in order. Other columns are ignored. No rows:
no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsloom.llm.common import WORD, screened, unscreened
from oddsloom.session import settle

HASH_BITS = 60
LEVEL_BITS = 12
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Sources up to which the plan, a row each, is broadcast.
BROADCAST_SOURCES = 1 << 16


def hash_of(column: Column) -> Column:
    """60 bits of the MD5 of a value's text."""
    digest = F.md5(F.coalesce(column.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def targets(sources: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """`target` per row of `sources` (source, source_size): shares of the whole by weight, at most
    `most` times a source's size, the excess reshared by weight until none is above.

    One row per source: numbering them in order is a window over that small table. A round only fixes
    the sources above the common level and raises it, so rounds end when no more are fixed."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    table = settle(sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1)))
    size, w = F.col("source_size"), F.col("w")
    whole = table.agg(F.sum("source_size"), F.sum("w"), F.count(F.lit(1))).first()
    if not whole[2]:
        return table.withColumn("target", F.lit(0.0)).drop("w")
    budget, open_w, fixed = share * whole[0], whole[1], 0
    left = budget
    while True:
        level = F.lit(float(left)) * w / F.lit(float(open_w))
        full = level > most * size
        now = table.agg(F.sum(F.when(full, size)), F.sum(F.when(~full, w)), F.count_if(full)).first()
        if now[2] == fixed:
            break
        left, open_w, fixed = budget - most * (now[0] or 0), now[1] or 1, now[2]
    return table.select("source", "source_size", F.when(full, (most * size).cast("double")).otherwise(level).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame, bits: int = HASH_BITS, step: int = LEVEL_BITS) -> DataFrame:
    """`cut` per source: the largest hash with which the taken sum lies nearest to `rest`.

    Two histogram levels leave the rows of one bucket in 2^24 of a source; they are summed by hash."""
    by, edge = Window.partitionBy("source"), budgets.withColumns({"base": F.lit(0).cast("bigint"), "floor": F.lit(0).cast("bigint")})
    narrow = rows
    for depth in (1, 2, None):
        shift = bits - step * depth if depth else 0
        slot = F.shiftright("h", shift)
        part = narrow.groupBy("source", slot.alias("slot")).agg(F.sum("size").alias("size"))
        part = part.withColumn("r_source", F.col("source")).drop("source")
        seen = part.join(edge, F.col("r_source").eqNullSafe(F.col("source"))).drop("r_source")
        upto = F.col("base") + F.sum("size").over(by.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
        seen = seen.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("size"))
        if depth is None:
            near = F.col("before") + F.col("upto") <= 2 * F.col("rest")
            last = seen.groupBy("source").agg(F.max(F.when(near, F.col("slot"))).alias("last"), F.first("floor").alias("floor"))
            met = last.select("source", F.coalesce("last", F.col("floor") - 1).alias("cut"))
            every = budgets.select(F.col("source").alias("b_source"))
            return every.join(met, F.col("b_source").eqNullSafe(F.col("source")), "left").select(
                F.col("b_source").alias("source"), F.coalesce("cut", F.lit((1 << bits) - 1)).alias("cut"))
        over = seen.filter(F.col("upto") > F.col("rest"))
        edge = settle(over.groupBy("source").agg(
            F.min_by(F.struct("slot", "before", "rest"), "slot").alias("e")
        ).select("source", F.col("e.rest").alias("rest"), F.col("e.before").alias("base"),
                 F.shiftleft("e.slot", shift).alias("floor")))
        ends = edge.select(F.col("source").alias("e_source"), F.shiftright("floor", shift).alias("e_slot"))
        narrow = settle(narrow.join(ends, narrow["source"].eqNullSafe(ends["e_source"]) & (slot == F.col("e_slot")), "left_semi"))


def plan(rows: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """(p_source, source_size, target, passes, cut): a document is taken `passes` times, and once more up to hash `cut`."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = settle(targets(sums, weights, share, most).withColumn(
        "passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    ).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")))
    cuts = thresholds(rows.select("source", "h", "size"), table.select("source", "rest")).withColumnRenamed("source", "c_source")
    met = table.join(cuts, table["source"].eqNullSafe(cuts["c_source"]))
    return settle(met.select(F.col("source").alias("p_source"), "source_size", "target", "passes", "cut"))


def planned(rows: DataFrame, table: DataFrame, source: Column, h: Column, most: int) -> DataFrame:
    """`rows` with the plan of their source and their `copies`. A small plan is broadcast; a large one meets the
    rows in a join whose skewed partitions Spark splits."""
    small = table.count() <= BROADCAST_SOURCES
    met = rows.join(F.broadcast(table) if small else table, source.eqNullSafe(table["p_source"]))
    copies = F.col("passes") + F.when(h <= F.col("cut"), 1).otherwise(0)
    return met.withColumn("copies", F.least(copies, F.lit(most)).cast("bigint"))


def keyed(rows: DataFrame) -> DataFrame:
    """`rows` (id, source, digest, ...) with their hash `h` in place of the digest; rows of one id and source with equal texts are numbered.

    Rows with an id of their own are not moved. Equal rows are numbered inside the tasks that read them, after what
    the tasks before them hold, so that no number of them meets in one place."""
    many = settle(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias("__id"), F.lit(True).alias("__many")))
    if not many.limit(1).count():
        return rows.withColumn("h", hash_of(F.col("id"))).drop("digest")
    known = screened(rows, F.col("id"), many, "__id").join(many, F.col("id").eqNullSafe(F.col("__id")), "left")
    single = unscreened(rows, F.col("id"), many, "__id").unionByName(known.filter("__many IS NULL").select(*rows.columns))
    again = settle(known.filter("__many").select(*rows.columns, F.monotonically_increasing_id().alias("__seq")))
    again = again.withColumn("__task", F.shiftright("__seq", 33))
    same = ("id", "source", "digest")
    held = again.groupBy(*same, "__task").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*same).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select(*[F.col(c).alias(f"__{c}_") for c in (*same, "__task")], F.coalesce(before, F.lit(0)).alias("__before"))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}_")) for c in (*same, "__task")]
    nth = F.col("__before") + F.row_number().over(Window.partitionBy(*same, "__task").orderBy("__seq"))
    met = again.join(held, on)
    text = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), "digest", nth.cast("string"))
    met = met.withColumn("__text", text).withColumn("h", hash_of(F.col("__text")))
    return single.withColumn("h", hash_of(F.col("id"))).drop("digest").unionByName(met.select(*[c for c in rows.columns if c != "digest"], "h"))


def _facts(id_col: str, text_col: str, source_col: str) -> list[Column]:
    """What `keyed` needs of a row."""
    return [F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("digest")]


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    return settle(keyed(docs.select(*_facts(id_col, text_col, source_col), size.alias("size"))))


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) per row of `docs`."""
    rows = _rows(docs, id_col, text_col, source_col)
    met = planned(rows, plan(rows, weights, share, most), F.col("source"), F.col("h"), most)
    return met.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


def mixed(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST,
) -> DataFrame:
    """The rows of `docs` as often as the mix takes them, with all their columns."""
    table = plan(_rows(docs, id_col, text_col, source_col), weights, share, most)
    told = keyed(docs.select(*_facts(id_col, text_col, source_col), F.struct("*").alias("row")))
    met = planned(told, table, F.col("source"), F.col("h"), most)
    again = met.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return again.select("row.*")
