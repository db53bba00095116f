"""Live health of feeds by processing-time timers: a feed that stops is told from the clock, without a row arriving."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from oddsloom.streaming.run import Keyed, due, process, typed

EVENT, REQUIRED, GAP, MENDED = "event", "required", "gap", "mended"
_MS = 1_000_000
#: Groups of feeds that share a state and a timer.
BUCKETS = 8_192


class FeedWatch(Keyed):
    """A row per change of a required feed's state: silent, gap, future, stale or ok, the first that holds.

    Rows: `feed`, `kind` and `ts_ns`. A `required` row makes a feed one that is watched, silent until it is heard; an `event` carries
    its time; a `gap` holds until a `mended` row. Feeds that nobody requires have a state and no rows. Of several rows of a
    micro-batch only the state they end in counts. Events older than the newest, repeated rows and events without a time change nothing.

    The key is a bucket of feeds: where feeds are many, a state and a timer for each cost more than their work. A bucket is read and
    written once a micro-batch. Its one timer stands at the first time at which the clock alone would change a state: when the
    newest event of a feed becomes `stale_ns` old, or is no longer `future_ns` ahead.
    """

    schema = "feed string, change bigint, at_ms bigint, last_ts bigint, state string"

    def __init__(self, stale_ns: int, future_ns: int):
        self.stale_ns, self.future_ns = stale_ns, future_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState(
            "bucket", "feeds array<struct<feed:string,required:boolean,last:bigint,gaps:bigint,told:string,change:bigint>>, timer bigint"
        )

    def _known(self) -> tuple[dict, int | None]:
        """What is kept of each feed (required, last, gaps, told, change), and the bucket's timer."""
        found = self.bucket.get()
        return ({feed: list(kept) for feed, *kept in found[0]}, found[1]) if found else ({}, None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        feeds, timer = self._known()
        of = lambda feed: feeds.setdefault(feed if isinstance(feed, str) else None, [False, None, 0, None, 0])
        for frame in rows:
            newest = frame[frame["kind"] == EVENT].groupby("feed", dropna=False)["ts_ns"].max()
            for feed, ts in zip(newest.index, newest.tolist()):
                kept = of(feed)
                kept[1] = ts if kept[1] is None else max(ts, kept[1])
            for feed, kind in zip(frame["feed"].tolist(), frame["kind"].tolist()):
                if kind == EVENT:
                    continue
                kept = of(feed)
                if kind == REQUIRED:
                    kept[0] = True
                elif kind == GAP:
                    kept[2] += 1
                elif kind == MENDED:
                    # A mended feed has no gap left, whatever the order of the batch's rows says of those before.
                    kept[2] = 0
        yield self._tell(feeds, timer, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._tell(self._known()[0], None, timerValues)

    def _tell(self, feeds: dict, timer: int | None, timerValues) -> pd.DataFrame:
        now_ms, clocks, out = timerValues.getCurrentProcessingTimeInMs(), [], []
        for feed, kept in feeds.items():
            required, last, gaps, told, change = kept
            age = None if last is None else now_ms * _MS - last
            if age is None:
                state = "silent"
            elif age < -self.future_ns:
                state = "future"
                clocks.append(due(last - self.future_ns))
            elif age > self.stale_ns:
                state = "stale"
            else:
                state = "ok"
                clocks.append(due(last + self.stale_ns))
            if gaps and age is not None:
                state = "gap"
            if required and state != told:
                kept[3:] = state, change + 1
                out.append((feed, change + 1, now_ms, last, state))
        clock = min(clocks, default=None)
        if timer != clock:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if clock is not None:
                self.handle.registerTimer(clock)
        self.bucket.update(([(feed, *kept) for feed, kept in feeds.items()], clock))
        return typed(out, self.schema)


def feed_watch(rows: DataFrame, *, feed: str, stale_ns: int, future_ns: int = 5_000_000_000, buckets: int = BUCKETS) -> DataFrame:
    """Changes of state (feed, change, at_ms, last_ts, state) of a stream of (feed, kind, ts_ns); `change` counts them per feed.

    Feeds are kept in `buckets` by hash; a checkpoint belongs to one number of them. A bucket's feeds are in memory together, some
    hundred for millions of feeds. Run it with a processing-time trigger: timers are looked at once a micro-batch, with or without new rows."""
    kind = rows.schema[feed].dataType.simpleString()
    # A null among whole numbers would make them floats on the way to Python, which hold no nanoseconds.
    timed = F.when((F.col("kind") != EVENT) | F.col("ts_ns").isNotNull(), F.col("kind")).alias("kind")
    put = F.pmod(F.xxhash64(feed), F.lit(buckets)).cast("int").alias("bucket")
    packed = rows.select(put, F.col(feed).cast("string").alias("feed"), timed, F.coalesce("ts_ns", F.lit(0)).alias("ts_ns"))
    told = process(packed, ["bucket"], FeedWatch(stale_ns, future_ns), time_mode="ProcessingTime", frames=True)
    return told.select(F.col("feed").cast(kind).alias(feed), "change", "at_ms", "last_ts", "state")
