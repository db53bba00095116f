"""Windows over calm stretches after wild prices: only what lies in a window may enter its sums."""

import numpy as np
import pandas as pd
import pytest

from oddsloom.operators import features as ft
from oddsloom.operators import portfolio as pf

SECOND = 1_000_000_000


def prices(wild: int, calm: int, step: float) -> np.ndarray:
    rng = np.random.default_rng(7)
    return np.concatenate([np.where(np.arange(wild) % 2, 0.99, 0.01), 0.5 + np.cumsum(rng.normal(0, step, calm))])


@pytest.mark.parametrize("hot", ["0", "2000000"])
@pytest.mark.parametrize("step", [1e-4, 1e-5])
def test_rolling_sharpe_equals_a_direct_window(spark, hot, step, monkeypatch):
    monkeypatch.setattr(pf, "SHARPE_ROWS", 1_500)
    spark.conf.set("oddsloom.hotRows", hot)
    price = prices(4_000, 6_000, step)
    ts = np.arange(len(price)) * SECOND
    table = spark.createDataFrame(pd.DataFrame({"market": "m", "ts": ts, "price": price}))
    out = pf.rolling_sharpe(table, key="market", order=["ts"], value="price", width=500 * SECOND, median_width=float(SECOND))
    got = out.toPandas().sort_values("ts")["sharpe"].to_numpy()
    spark.conf.set("oddsloom.hotRows", "0")
    ret = price[1:] / price[:-1] - 1
    frames = np.lib.stride_tricks.sliding_window_view(ret, 500)
    want = frames.mean(axis=1) / frames.std(axis=1, ddof=1) * np.sqrt(365.25 * 86_400)
    assert np.isnan(got[:500]).all() and not np.isnan(got[500:]).any()
    np.testing.assert_allclose(got[500:], want, rtol=1e-7, atol=1e-7)


@pytest.mark.parametrize("hot", ["0", "2000000"])
def test_volatility_equals_a_direct_window(spark, hot):
    spark.conf.set("oddsloom.hotRows", hot)
    price = prices(20_000, 3_000, 1e-5)
    ts = np.arange(len(price)) * SECOND // 4
    trades = pd.DataFrame({"market": "m", "ts": ts, "price": price, "quantity": 1.0, "aggressor_side": "buy", "seq": np.arange(len(price))})
    at = ts[-1] - np.arange(0, 600, 7) * SECOND - 3
    decisions = spark.createDataFrame(pd.DataFrame({"market": "m", "decision_ts": at}))
    windows = {"5s": 5 * SECOND, "30s": 30 * SECOND, "7s": 7 * SECOND}
    out = ft.trade_windows(
        decisions, spark.createDataFrame(trades), keys=["market"], decision_ts="decision_ts", ts="ts", tie=["seq"], windows_ns=windows, width=300 * SECOND
    ).toPandas()
    spark.conf.set("oddsloom.hotRows", "0")
    log = np.log(price)
    assert len(out) == len(at)
    for row in out.itertuples():
        for w, span in windows.items():
            a, b = np.searchsorted(ts, row.decision_ts - span), np.searchsorted(ts, row.decision_ts, "right")
            want = np.sqrt((np.diff(log[a:b]) ** 2).sum())
            assert getattr(row, f"rv_{w}") == pytest.approx(want, rel=1e-9), (w, row.decision_ts)
            assert getattr(row, f"return_{w}") == pytest.approx(log[b - 1] - log[a], rel=1e-9, abs=1e-15)
