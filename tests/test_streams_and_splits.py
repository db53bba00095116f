"""Streams in several micro-batches against batch twins and replays; splits; causality."""

import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oddsloom.operators import dataset, features, quality, selection, signals
from oddsloom.operators.timeline import fitting_width
from oddsloom.sources import store
from oddsloom.streaming import gate, ladder
from oddsloom.streaming import run as st

NS = 1_000_000_000


def batches(spark, df, pos, n=3):
    """The rows as a stream of `n` files in arrival order, one per micro-batch."""
    import time

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/in"
    rows = df.toPandas().sort_values(pos)
    for part in np.array_split(np.arange(len(rows)), n):
        spark.createDataFrame(rows.iloc[part], df.schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    return st.read_stream(spark, folder, files_per_trigger=1)


def events(spark, n=200):
    rng = np.random.default_rng(1)
    return spark.createDataFrame(
        pd.DataFrame(
            {
                "user_id": rng.integers(0, 3, n), "pos": np.arange(n), "identifier": [f"h{x}" for x in rng.integers(0, 60, n)],
                "available_ts": np.arange(n) * 10 - rng.integers(0, 25, n), "source_ts": np.arange(n) * 10, "receive_ts": np.arange(n) * 10 + rng.integers(0, 9, n),
            }
        )
    )


def test_gate_stream_over_batches_equals_the_batch_job(spark):
    df = events(spark)
    streamed = st.drain(st.process(batches(spark, df, "pos"), ["user_id"], gate.QualityGate(max_seen=10, max_delay_ns=5)))
    batch = quality.quality_gate(
        df, keys=["user_id"], pos="pos", identifier="identifier", available="available_ts", source_ts="source_ts",
        receive_ts="receive_ts", width=50, max_seen=10, max_delay_ns=5,
    ).select(*streamed.columns)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
    assert {r.status for r in streamed.collect()} == {"accepted", "duplicate", "out_of_order"}


LEVELS = "array<struct<price:double,size:double>>"


def test_depth_sync_buffers_applies_and_detects_gaps(spark, rows):
    lv = lambda *xs: [{"price": p, "size": s} for p, s in xs]
    data = [
        (1, 0, "delta", 5, 8, lv((0.40, 1.0)), []),
        (1, 1, "delta", 9, 11, lv((0.41, 2.0)), lv((0.60, 1.0))),
        (1, 2, "snapshot", 0, 8, lv((0.39, 5.0)), lv((0.61, 5.0))),
        (1, 3, "delta", 12, 12, lv((0.41, 0.0)), []),
        (1, 4, "delta", 10, 12, [], []),
        (1, 5, "delta", 15, 16, [], []),
        (1, 6, "delta", 17, 18, lv((0.42, 1.0)), []),
        (1, 7, "snapshot", 0, 16, lv((0.30, 1.0)), lv((0.70, 1.0))),
    ]
    df = spark.createDataFrame(data, f"user_id bigint, pos bigint, kind string, first_id bigint, final_id bigint, bids {LEVELS}, asks {LEVELS}")
    out = st.drain(st.process(batches(spark, df, "pos"), ["user_id"], ladder.DepthSync()))
    assert rows(out, "status", "last_id", "bid", "ask", order=["pos"]) == [
        ("awaiting_snapshot", None, None, None),
        ("awaiting_snapshot", None, None, None),
        ("applied", 11, 0.41, 0.60),
        ("applied", 12, 0.39, 0.60),
        ("stale", 12, None, None),
        ("gap", None, None, None),
        ("awaiting_snapshot", None, None, None),
        ("applied", 18, 0.42, 0.70),
    ]


def test_token_books_wait_for_a_snapshot_after_a_cross(spark, rows):
    lv = lambda *xs: [{"price": p, "size": s} for p, s in xs]
    data = [
        (7, 0, 100, 100, "price_change", [], [], "BUY", 0.3, 1.0),
        (7, 1, 110, 120, "book", lv((0.4, 1.0)), lv((0.6, 2.0)), None, None, None),
        (7, 2, 111, 112, "price_change", [], [], "BUY", 0.45, 3.0),
        (7, 3, 112, 130, "price_change", [], [], "SELL", 0.44, 1.0),
        (7, 4, 113, 131, "price_change", [], [], "SELL", 0.7, 1.0),
        (7, 5, 50, 60, "book", lv((0.2, 1.0)), lv((0.8, 2.0)), None, None, None),
    ]
    df = spark.createDataFrame(
        data,
        f"asset_id bigint, pos bigint, source_ts bigint, receive_ts bigint, event_type string, bids {LEVELS}, asks {LEVELS}, side string, price double, size double",
    )
    out = st.drain(st.process(batches(spark, df, "pos"), ["asset_id"], ladder.TokenBooks(tolerance_ns=20)))
    assert rows(out, "status", "available_ts", "bid", "ask", order=["pos"]) == [
        ("awaiting_snapshot", 100, None, None),
        ("applied", 120, 0.4, 0.6),
        ("applied", 120, 0.45, 0.6),
        ("invalid", 130, None, None),
        ("awaiting_snapshot", 131, None, None),
        ("applied", 60, 0.2, 0.8),
    ]


def ticks(spark, n=300):
    rng = np.random.default_rng(4)
    return spark.createDataFrame(
        pd.DataFrame(
            {
                "user_id": rng.integers(0, 3, n), "event_id": np.arange(n), "ts_ns": np.cumsum(rng.integers(1, 9, n)),
                "is_trade": rng.random(n) < 0.7, "price": rng.integers(1, 99, n) / 100, "quantity": rng.integers(0, 5, n).astype(float),
                "sign": np.where(rng.random(n) < 0.5, 1.0, -1.0),
            }
        )
    )


def trailing(df, window=60):
    trades = df.filter("is_trade").select(
        "user_id", "ts_ns", F.col("event_id").alias("no"), "price", "quantity",
        F.when(F.col("sign") > 0, "buy").otherwise("sell").alias("aggressor_side"),
    )
    decisions = df.filter("NOT is_trade").select("user_id", "event_id", F.col("ts_ns").alias("t"))
    return features.trade_windows(
        decisions, trades, keys=["user_id"], decision_ts="t", ts="ts_ns", tie=["no"], windows_ns={"w": window}, width=70
    ).select("user_id", "event_id", "return_w", "rv_w", "flow_w")


def test_trailing_stream_equals_the_prefix_sum_job(spark):
    df = ticks(spark)
    streamed = st.drain(st.process(batches(spark, df, "event_id"), ["user_id"], gate.TrailingTrades(60))).orderBy("event_id").toPandas()
    batch = trailing(df).orderBy("event_id").toPandas()
    assert (streamed.event_id == batch.event_id).all()
    np.testing.assert_allclose(streamed[["ret", "rv", "flow"]], batch[["return_w", "rv_w", "flow_w"]], atol=1e-9)


def test_a_later_event_changes_no_earlier_feature(spark):
    df = ticks(spark)
    cut = df.filter("event_id < 200")
    full = {r.event_id: tuple(r) for r in trailing(df).collect()}
    for r in trailing(cut).collect():
        assert tuple(r) == pytest.approx(full[r.event_id])


def test_walk_forward_keeps_groups_whole_and_labels_known(spark):
    day = 86_400 * NS
    data = [(f"s{i}", f"g{i // 2}", i * day, i * day + (i % 7) * day) for i in range(120)]
    df = spark.createDataFrame(data, "sample_id string, group_id string, feature_ts bigint, label_available_ts bigint")
    cfg = dict(train=30 * day, calibration=10 * day, test=8 * day, step=8 * day, embargo=day, holdout=20 * day)
    out = dataset.walk_forward(df, **cfg).join(df.drop("group_id"), "sample_id").toPandas()
    sealed = out[out.role == "holdout"]
    assert sealed.feature_ts.min() == 98 * day and sealed.fold.unique().tolist() == [-1]
    folds = sorted(set(out.fold) - {-1})
    assert folds == list(range(len(folds))) and len(folds) >= 4
    for _, fold in out[out.fold >= 0].groupby("fold"):
        train, cal, test = (fold[fold.role == r] for r in ("train", "calibration", "test"))
        assert train.feature_ts.max() < cal.feature_ts.min() <= cal.feature_ts.max() < test.feature_ts.min()
        assert train.label_available_ts.max() <= cal.feature_ts.min() - day + day
        assert test.feature_ts.max() < sealed.feature_ts.min()
        for part in (train, cal, test):
            assert (part.groupby("group_id").size() == 2).all()


def test_store_months_versions_and_schema_guard(spark, rows):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/store"
    day = 86_400 * NS
    df = spark.createDataFrame([("a", "x", i * 10 * day, "trades", float(i)) for i in range(12)], "slug string, segment string, ts bigint, ch string, v double")
    store.write_store(df, path, channel="ch", ts_ns="ts", slug="slug", segment="segment")
    got = store.read_store(spark, path, channel="trades", start_ns=30 * day, end_ns=60 * day, ts_ns="ts")
    assert [r[0] for r in rows(got, "v", order=["v"])] == [3.0, 4.0, 5.0, 6.0]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "year" in plan.split("PartitionFilters")[1][:300]
    with pytest.raises(ValueError):
        store.append_aligned(df, df.withColumn("v", F.col("v").cast("string")))
    wider = store.append_aligned(df.withColumn("n", F.lit(None)), df.withColumn("n", F.lit(1)))
    assert dict(wider.dtypes)["n"] == "int" and wider.count() == 24


def test_a_malformed_raw_row_fails_the_read(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/raw"
    row = (5, None, 4, "q", "s", "i", "v", "a", 0, "{}")
    cols = "source_ts_ns bigint, collector_receive_ts_ns bigint, available_ts_ns bigint, sequence_or_hash string, source string, instrument string, schema_version string, ingest_version string, epoch_id bigint, payload_json string"
    store.write_raw(spark.createDataFrame([row], cols), path)
    out = store.read_raw(spark, path, source="s", instrument="i", ingest_version="a", start_ns=0, end_ns=9)
    with pytest.raises(Exception, match="malformed raw event"):
        out.collect()


def test_filters_reach_the_scan(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/l2"
    spark.createDataFrame([(b"m1", "book", "t", 1)], "market binary, event_type string, asset_id string, x int").write.parquet(path)
    plan = store.scan_l2(spark.read.parquet(path), market="m1", token="t").select("x")._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters")[1]
    assert "EqualTo(market," in pushed and "In(event_type," in pushed and "IsNotNull(asset_id)" in pushed


def test_recursive_signals_over_chunks(spark):
    x = np.random.default_rng(9).random(80)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "t": np.arange(80), "p": x}))
    ema = signals.ema_crossover(df, keys=["k"], order=["t"], price="p", fast=3, slow=8, buffer=0.0, width=20, rows_per_chunk=11)
    f, s, want = x[:3].mean(), x[:8].mean(), []
    for v in x[8:]:
        f, s = 0.5 * v + 0.5 * f, 2 / 9 * v + 7 / 9 * s
        want.append((f, s))
    got = ema.orderBy("t").toPandas()
    np.testing.assert_allclose(got[["fast_ema", "slow_ema"]], want)
    rsi = signals.rsi(df, keys=["k"], order=["t"], price="p", period=5, width=20, rows_per_chunk=7).orderBy("t").toPandas()
    d = np.diff(x)
    g, l = np.maximum(d, 0)[:5].mean(), np.maximum(-d, 0)[:5].mean()
    want = [100 - 100 / (1 + g / l)]
    for v in d[5:]:
        g, l = (g * 4 + max(v, 0)) / 5, (l * 4 + max(-v, 0)) / 5
        want.append(100 - 100 / (1 + g / l))
    np.testing.assert_allclose(rsi.rsi, want)


def test_downsampling_keeps_the_ends_and_extremes(spark):
    v = np.random.default_rng(2).random(2_000)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "t": np.arange(2_000), "v": v}))
    out = selection.downsample(df, keys=["k"], order=["t"], value="v", max_points=150, width=300).toPandas()
    assert {0, 1999, int(v.argmin()), int(v.argmax())} <= set(out.bar)
    # 154 strided rows and three of the four kept ones beside them: thinning by 154 // 146 changes nothing.
    assert len(out) == 157
    few = selection.downsample(df.filter("t < 100"), keys=["k"], order=["t"], value="v", max_points=150, width=300)
    assert few.count() == 100


def test_fitting_width_shrinks_with_density(spark):
    df = spark.range(1_000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    assert fitting_width(df, ["k"], "t", 50, 500) == 50


def test_catalog_has_sql_and_unique_names():
    from oddsloom.plans import load_catalog

    catalog = load_catalog()
    assert len(catalog) > 140
    assert sum(q.sql is not None for q in catalog.values()) > 140
