"""Chains of scans: one sketch for all of them, bursts are cut, results as with plain windows."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from oddsloom.operators import books, trades
from oddsloom.operators import timeline as tl
from oddsloom.operators.timeline import Timeline, find_cuts, latest, number, occurrence, running_sum, scan, whole_max


@pytest.fixture(params=["0", "50", "1000000"])
def hot(spark, request):
    before = spark.conf.get("oddsloom.hotRows")
    spark.conf.set("oddsloom.hotRows", request.param)
    yield int(request.param)
    spark.conf.set("oddsloom.hotRows", before)


def rows(spark, n=400):
    """Key 1 has most rows, nearly all of them in one burst far shorter than the width; some times are null."""
    data = [(1 if i % 8 else i % 5, None if i % 97 == 0 else (500 + (i * 7) % 90 if i % 8 else i * 10_000), i, float(i % 11)) for i in range(n)]
    return spark.createDataFrame(data, "k int, ts long, pos long, v double")


def test_scans_over_cuts_equal_plain_windows(spark, hot):
    df = rows(spark)
    cuts = find_cuts(df, "k", "ts", 1_000)
    outs = {"sum": running_sum(F.col("v")), "last": latest(F.when(F.col("v") > 5, F.col("v"))), "most": whole_max(F.col("v"))}
    got = scan(cuts.mark(df), cuts.line("k", ["ts", "pos"]), outs)
    got = number(got, cuts.line(["k", "v"], ["ts", "pos"]), "nth")
    got = occurrence(got, cuts.line("k", ["ts", "pos"]), "ts", "same").drop(tl.CUT)
    want = scan(df, Timeline.of("k", ["ts", "pos"], None), outs)
    want = number(want, Timeline.of(["k", "v"], ["ts", "pos"], None), "nth")
    want = occurrence(want, Timeline.of("k", ["ts", "pos"], None), "ts", "same")
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_a_burst_is_several_chunks(spark):
    spark.conf.set("oddsloom.hotRows", "50")
    try:
        df = rows(spark, 4000)
        cuts = find_cuts(df, "k", "ts", 10**9)
        sizes = [r["count"] for r in cuts.mark(df).filter("k = 1 AND ts IS NOT NULL").groupBy(tl.CUT).count().collect()]
        assert len(sizes) > 50 and max(sizes) < 400
        order = cuts.mark(df).filter("k = 1 AND ts IS NOT NULL").select("ts", F.col(f"{tl.CUT}.nth").alias("c")).orderBy("ts").collect()
        assert all(a.c <= b.c and (a.ts < b.ts or a.c == b.c) for a, b in zip(order, order[1:]))
    finally:
        spark.conf.set("oddsloom.hotRows", "0")


def counted(spark, df):
    """`df`, and a counter of the rows that were read from it."""
    seen = spark.sparkContext.accumulator(0)

    def tell(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    return df.mapInPandas(tell, df.schema), seen


def test_fills_and_deltas_read_their_source_twice(spark, hot):
    n = 300
    fills = pd.DataFrame({"token": ["t1"] * 250 + ["t2"] * 50, "timestamp_ns": [1000 + i // 3 for i in range(n)], "price": ["0.5"] * n, "size": ["2"] * n,
                          "side": ["buy"] * n, "id": [f"x{i % 40}" for i in range(n)], "pos": range(n)})
    source, seen = counted(spark, spark.createDataFrame(fills).repartition(4))
    out = trades.onchain_fills(source, token="token", start=0, end=10**6, width=50)
    got = out.collect()
    assert len(got) == n and seen.value <= 2 * n
    want = fills["timestamp_ns"] + fills.groupby(["token", "timestamp_ns"]).cumcount()
    assert sorted(r.ts_event for r in got) == sorted(want)
    level = [["0.4", "1"]]
    book = [("t1" if i % 9 else "t2", 10 * i, 10 * i + 1, i, "book" if i % 5 == 0 else "price_change", level, level, "0.3", "1", "BUY") for i in range(n)]
    schema = "asset_id string, timestamp_ns long, timestamp_received_ns long, pos long, event_type string, bids array<array<string>>, asks array<array<string>>, price string, size string, side string"
    source, seen = counted(spark, spark.createDataFrame(book, schema).repartition(4))
    assert books.l2_deltas(source, start=0, end=10**6, width=100).count() > n
    assert seen.value <= 2 * n


def test_no_rows(spark):
    df = rows(spark).filter("false")
    cuts = find_cuts(df, "k", "ts", 10)
    assert number(cuts.mark(df), cuts.line("k", ["ts", "pos"])).count() == 0


def test_doubles_lead_too(spark, hot):
    df = rows(spark).withColumn("ts", F.col("ts") / 7)
    cuts = find_cuts(df, "k", "ts", 100.0)
    got = number(cuts.mark(df), cuts.line("k", ["ts", "pos"])).drop(tl.CUT)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, number(df, Timeline.of("k", ["ts", "pos"], None)).collect()))
