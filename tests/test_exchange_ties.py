"""Exchange prints without a hot ticker take one pass; ties are the same as on cut tickers."""

import pytest

from oddsloom.operators import trades


@pytest.fixture
def prints(spark):
    rows = [(f"T{i % 3}", i // 9 * 10**9 if i % 10 else None, f"{i * 7 % 90:03d}", "50", "2", ["yes", "no", ""][i % 3], f"id{i}") for i in range(90)]
    return spark.createDataFrame(rows, "ticker string, ts_ns bigint, pos string, yes_price string, count string, taker_side string, trade_id string")


def test_one_pass_without_hot_tickers(spark, prints):
    before = spark.conf.get("oddsloom.hotRows")
    found = {}
    try:
        for hot in ("0", "20", "1000"):
            spark.conf.set("oddsloom.hotRows", hot)
            out = trades.exchange_trades(prints, width=10**10, fallback_ids=False)
            found[hot] = sorted(map(repr, out.collect()))
            if hot == "1000":
                plan = out._jdf.queryExecution().optimizedPlan().toString()
                assert "row_number()" in plan and "lag(" not in plan
    finally:
        spark.conf.set("oddsloom.hotRows", before)
    assert len(found["0"]) == 90 and found["0"] == found["20"] == found["1000"]
