"""Fills take the text of a price once per step, and lie in tasks of a bounded number of rows."""

import pytest
from pyspark.sql import functions as F

from oddsloom.operators import timeline as tl
from oddsloom.operators import trades

ODD = ["0.5", " 0.25 ", "0", "1", "1.0", "-0.5", "nan", "NaN", "inf", "-Infinity", "bad", "", None, "1e-3", "5e-1", "150"]


@pytest.fixture(params=["0", "40", "2000000"])
def hot(spark, request):
    before = spark.conf.get("oddsloom.hotRows")
    spark.conf.set("oddsloom.hotRows", request.param)
    yield
    spark.conf.set("oddsloom.hotRows", before)


def prints(spark, price, size=None, n=900):
    """`n` prints of 9 tokens in pairs of one instant."""
    i = F.col("id")
    return spark.range(n).select(
        (i % 9).alias("token"), F.floor(i / 18).alias("timestamp_ns"), i.alias("pos"), price.alias("price"),
        (F.lit("2") if size is None else size).alias("size"), F.lit("buy").alias("side"),
        F.concat(F.lit("x"), (i % 5).cast("string")).alias("id_"),
    ).withColumnRenamed("id_", "id")


def fills(df):
    return trades.onchain_fills(df, token="token", start=0, end=10**6, width=10)


def ticks(df):
    rows = df.withColumns({"asset_id": F.col("token"), "timestamp_received_ns": F.col("timestamp_ns"), "event_type": F.lit("last_trade_price"),
                           "transaction_hash": F.col("id")})
    return trades.last_trade_ticks(rows, start=0, end=10**6)


@pytest.mark.parametrize("made", [fills, ticks])
def test_a_costly_text_is_made_once_for_the_filter_and_once_for_the_value(spark, hot, made):
    text = F.translate(F.concat(F.lit("0,"), (F.col("id") % 10).cast("string")), ",", ".")
    out = made(prints(spark, text))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("translate(") <= 2
    assert out.count() == 810


def odd_texts():
    return F.element_at(F.array(*[F.lit(t) for t in ODD]), (F.col("id") % len(ODD) + 1).cast("int"))


@pytest.mark.parametrize("made", [fills, ticks])
def test_odd_prices_and_sizes(spark, hot, made):
    times = 640 // len(ODD)
    as_price = made(prints(spark, odd_texts(), n=640)).select("price").collect()
    assert sorted(r.price for r in as_price) == sorted([0.5, 0.25, 1e-3, 0.5] * times)
    as_size = made(prints(spark, F.lit("0.5"), odd_texts(), n=640)).select("size").collect()
    assert sorted(r.size for r in as_size) == sorted([0.5, 0.25, 1.0, 1.0, 1e-3, 0.5, 150.0] * times)


def test_odd_public_prices_and_dollars(spark, hot):
    rows = spark.range(len(ODD)).select(
        odd_texts().alias("price"), F.lit("2").alias("size"), F.lit("buy").alias("side"), F.lit("0xabc").alias("transaction_hash"),
        F.lit("asset").alias("asset"), F.col("id").alias("timestamp"),
    )
    out = trades.public_trades(rows, width_s=5).orderBy("timestamp").collect()
    value = [0.5, 0.25, 0.0, 1.0, 1.0, -0.5, None, None, None, None, None, None, None, 1e-3, 0.5, 150.0]
    assert [r.price_value for r in out] == value
    assert [r.tradable for r in out] == [v is not None and 0 < v < 1 for v in value]
    dollars = rows.select("timestamp", trades.dollar_price(F.col("price")).alias("d")).orderBy("timestamp").collect()
    assert [r.d for r in dollars] == [0.5, 0.25, 0.0, 0.01, 1.0, None, None, None, None, None, None, None, None, 1e-3, 0.5, None]


def test_fills_are_dealt_by_rows(spark, hot, monkeypatch):
    df = prints(spark, F.lit("0.5"))
    want = sorted(map(repr, fills(df).collect()))
    monkeypatch.setattr(tl, "MANY_ROWS", 100)
    monkeypatch.setattr(tl, "TASK_ROWS", 50)
    out = fills(df)
    if spark.conf.get("oddsloom.hotRows") == "2000000":
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and f", {tl.tasks_for(900)})" in plan
    assert sorted(map(repr, out.collect())) == want and len(want) == 900
