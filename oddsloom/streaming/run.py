"""Reading, running and sinking streams."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from oddsloom.session import shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful processors need this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet folder or file pattern as a stream, with the schema found there."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if path.endswith(".parquet"):
        # A single file is watched as a pattern that matches only it.
        path = path[: -len(".parquet")] + ".parque[t]"
    return reader.parquet(path)


def process(stream: DataFrame, keys: Sequence[str], processor: StatefulProcessor, time_mode: str = "None", frames: bool = False) -> DataFrame:
    """`time_mode` is EventTime or ProcessingTime for processors with timers; the former needs a watermark.

    `frames` hands a key's rows over as pandas frames: cheaper where a key has many, dearer where keys have few."""
    use_rocksdb(stream.sparkSession)
    if frames:
        return stream.groupBy(*keys).transformWithStateInPandas(processor, processor.schema, "Append", time_mode)
    return stream.groupBy(*keys).transformWithState(ByRow(processor), processor.schema, "Append", time_mode)


def drain(stream: DataFrame, *, mode: str = "append", partition_by: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """Run the stream over everything available and return what it wrote to the shared folder.

    Append streams go to partitioned files. Update streams write each micro-batch with its number,
    and the newest row per key is read back.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/oddsloom-stream-{uuid.uuid4().hex}"
    out, checkpoint = f"{base}/data", f"{base}/checkpoint"
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", out).outputMode("append")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
    else:

        def write(batch: DataFrame, number: int) -> None:
            batch.withColumn("__batch", F.lit(number)).write.mode("append").parquet(out)

        writer = stream.writeStream.outputMode(mode).foreachBatch(write)
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    columns = stream.columns
    schema = stream.schema if mode == "append" else stream.withColumn("__batch", F.lit(0)).schema
    written = spark.read.schema(schema).parquet(out)
    if mode == "append":
        return written.select(*columns)
    newest = F.max_by(F.struct(*columns), F.col("__batch"))
    return written.groupBy(*[F.col(k) for k in keys]).agg(newest.alias("__row")).select("__row.*")


def drain_live(stream: DataFrame, *, wait_s: float = 0.2) -> DataFrame:
    """What an append stream with processing-time timers writes until a micro-batch without new rows has ended.

    Such streams never end by themselves: their clock always asks for one more micro-batch."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/oddsloom-stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").option("path", f"{base}/data").option("checkpointLocation", f"{base}/checkpoint")
    query = writer.trigger(processingTime="0 seconds").start()
    try:
        while query.isActive and not ((p := query.lastProgress) and p["batchId"] > 0 and p["numInputRows"] == 0):
            time.sleep(wait_s)
        if query.exception():
            raise query.exception()
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


def tumbling(
    stream: DataFrame, *, keys: Sequence[str], event_time: str, length: str, late: str, aggs: Mapping[str, Column]
) -> DataFrame:
    """Windowed aggregation; the watermark only bounds the state, as late rows are epoch breaks upstream."""
    return (
        stream.withWatermark(event_time, late)
        .groupBy(*keys, F.window(event_time, length).alias("w"))
        .agg(*[column.alias(name) for name, column in aggs.items()])
        .select(*keys, (F.unix_micros("w.start") * 1000).alias("window_start"), *aggs)
    )


def feed_ages(stream: DataFrame, *, feed: str, ts: str) -> DataFrame:
    """Latest event time and count per feed."""
    return stream.groupBy(feed).agg(F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("events"))


def feed_health(
    ages: DataFrame, required: DataFrame, *, feed: str, now: Column, stale_ns: int, gaps: DataFrame | None = None,
    future_ns: int = 5_000_000_000,
) -> DataFrame:
    """State of each required feed: silent, gap, future, stale or ok."""
    out = required.join(ages, feed, "left")
    if gaps is not None:
        out = out.join(gaps.select(feed, F.col("gap_count")), feed, "left")
    else:
        out = out.withColumn("gap_count", F.lit(0))
    age = now - F.col("last_ts")
    state = (
        F.when(F.col("last_ts").isNull(), "silent")
        .when(F.coalesce("gap_count", F.lit(0)) > 0, "gap")
        .when(age < -future_ns, "future")
        .when(age > stale_ns, "stale")
        .otherwise("ok")
    )
    return out.select(feed, "last_ts", age.alias("age_ns"), state.alias("state"))


def due(ts_ns) -> int:
    """The first watermark, in milliseconds, that lies behind a time."""
    return int(ts_ns) // 1_000_000 + 1


def typed(rows: list[tuple], schema: str) -> pd.DataFrame:
    """Rows as a frame in which whole numbers stay whole beside nulls."""
    kinds = {"bigint": "Int64", "double": "float64", "boolean": "bool", "string": "object"}
    parts = [x.split() for x in schema.split(", ")]
    return pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype=kinds[t]) for k, (c, t) in enumerate(parts)})


class Keyed(StatefulProcessor):
    """A processor that answers the rows of a key, and its timers, with tuples of its schema; on frames it gives frames."""

    schema: str

    def answer(self, key, rows: list, timerValues) -> list[tuple]:
        raise NotImplementedError

    def expired(self, key, timerValues) -> list[tuple]:
        return []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield typed(self.answer(key, [r for frame in rows for r in frame.itertuples(index=False)], timerValues), self.schema)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield typed(self.expired(key, timerValues), self.schema)

    def close(self) -> None:
        pass


class ByRow(StatefulProcessor):
    """Runs a `Keyed` processor on Spark's rows: where keys are many, a frame per key and timer costs more than their work."""

    def __init__(self, made: Keyed):
        self.made, self.columns = made, [c.split()[0] for c in made.schema.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.made.init(handle)

    def _rows(self, found: list[tuple]) -> Iterator[Row]:
        row = Row(*self.columns)
        return (row(*r) for r in found)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        return self._rows(self.made.answer(key, list(rows), timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._rows(self.made.expired(key, timerValues))

    def close(self) -> None:
        self.made.close()


class Expiring(Keyed):
    """State that is forgotten `grace_ns` after `close_ns` of its rows, or `idle_ns` after the last event (`ts_ns`), by event-time timers.

    Without either it stays, and needs no watermark."""

    def __init__(self, closes: bool = False, grace_ns: int = 0, idle_ns: int | None = None):
        self.closes, self.grace_ns, self.idle_ns = closes, grace_ns, idle_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "heard bigint, close bigint")
        self.states = [self.life]

    def lives(self, rows: list) -> None:
        """Set the timers of a batch."""
        if not self.closes and self.idle_ns is None:
            return
        heard, close = self.life.get() if self.life.exists() else (None, None)
        if self.idle_ns is not None:
            heard = max(*(int(r.ts_ns) for r in rows), heard or 0)
            self.handle.registerTimer(due(heard + self.idle_ns))
        if self.closes and (ends := [int(r.close_ns) for r in rows if not pd.isna(r.close_ns)]):
            close = max(*ends, close or 0)
            self.handle.registerTimer(due(close + self.grace_ns))
        self.life.update((heard, close))

    def expired(self, key, timerValues) -> list[tuple]:
        passed = timerValues.getCurrentWatermarkInMs()
        heard, close = self.life.get() if self.life.exists() else (None, None)
        over = self.closes and close is not None and due(close + self.grace_ns) <= passed
        if over or self.idle_ns is not None and heard is not None and due(heard + self.idle_ns) <= passed:
            for state in self.states:
                state.clear()
        return []
