"""Feeds that fall silent while a stream runs."""

import tempfile
import time

from oddsloom.streaming import run as st
from oddsloom.streaming.feeds import feed_watch

SCHEMA = "feed string, kind string, ts_ns bigint"


def test_a_feed_that_stops_is_told_without_a_row(spark):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
    now = time.time_ns()
    year = 365 * 86_400 * 10**9
    put([
        *((f, "required", None) for f in ("live", "late", "never", "ahead", "torn", "mended")), ("live", "event", now), ("live", "event", now - 5), ("late", "event", now - year),
        ("ahead", "event", now + year), ("torn", "event", now), ("torn", "gap", None), ("mended", "event", now - year), ("mended", "gap", None), ("mended", "mended", None),
        ("unknown", "event", now), ("late", "event", None),
    ])
    changes = feed_watch(st.read_stream(spark, f"{base}/in"), feed="feed", stale_ns=40 * 10**9)
    query = changes.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(processingTime="1 second").start()

    def told(until):
        for _ in range(120):
            time.sleep(0.5)
            assert query.exception() is None
            rows = spark.read.schema(changes.schema).parquet(f"{base}/out").collect() if query.lastProgress else []
            seen = {}
            for r in sorted(rows, key=lambda r: (r.feed, r.change)):
                seen.setdefault(r.feed, []).append(r)
            if until({f: [r.state for r in x] for f, x in seen.items()}):
                return seen
        raise AssertionError(seen)

    try:
        first = told(lambda s: len(s) == 6)
        assert {f: x[0].state for f, x in first.items()} == {
            "live": "ok", "late": "stale", "never": "silent", "ahead": "future", "torn": "gap", "mended": "stale",
        }
        # No row comes from here on.
        last = told(lambda s: s["live"] == ["ok", "stale"])
        assert last["live"][1].at_ms >= (now + 40 * 10**9) // 10**6 and last["live"][1].last_ts == now
        assert [r.state for r in last["torn"]] == ["gap"] and "unknown" not in last
    finally:
        query.stop()
