"""Results that must not depend on limits or on which keys count as hot."""

import datetime as dt

import numpy as np
import pytest

from oddsloom.operators import evaluate, quality
from oddsloom.sources.store import group_stride


@pytest.mark.parametrize("hot", ["0", "2000000"])
@pytest.mark.parametrize("rounds", [1, 6])
def test_quality_gate_settles_on_few_identifiers_and_falling_times(spark, hot, rounds):
    rng = np.random.default_rng(8)
    data = []
    for key, idents in ((1, 3), (2, 40), (None, 5)):
        for i in range(2_000 if key == 1 else 300):
            at = int(i - rng.integers(0, 50))
            data.append((key, i, f"h{rng.integers(0, idents)}", at, 0, 0))
    df = spark.createDataFrame(data, "user_id bigint, pos bigint, identifier string, available_ts bigint, source_ts bigint, receive_ts bigint").filter("user_id IS NOT NULL")
    spark.conf.set("oddsloom.hotRows", hot)
    got = quality.quality_gate(
        df, keys=["user_id"], pos="pos", identifier="identifier", available="available_ts", source_ts="source_ts", receive_ts="receive_ts",
        width=200, rounds=rounds,
    ).collect()
    spark.conf.set("oddsloom.hotRows", "0")
    told = {(r.user_id, r.pos): (r.status, r.epoch_id) for r in got}
    state, falls = {}, 0
    for k, pos, ident, a, _, _ in data:
        if k is None:
            continue
        epoch, last, seen = state.get(k, (0, None, set()))
        if ident in seen:
            want = "duplicate"
        elif last is not None and a is not None and a < last:
            want, epoch, last, seen, falls = "out_of_order", epoch + 1, None, set(), falls + 1
        else:
            want, last, seen = "accepted", last if a is None else a, seen | {ident}
        state[k] = (epoch, last, seen)
        assert told[k, pos] == (want, epoch), (k, pos)
    assert falls > 50


@pytest.mark.parametrize("kind", ["text", "timestamp", "bigint", "none"])
def test_group_stride_is_the_same_for_any_hot_limit(spark, kind):
    rng = np.random.default_rng(9)
    lead = rng.permutation(90)
    value = {
        "text": lambda i: f"k{lead[i]:03d}", "timestamp": lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(hours=int(lead[i])),
        "bigint": lambda i: int(lead[i]), "none": lambda i: 0,
    }[kind]
    rows = [(f"btc-{i:02d}", value(i), j) for i in range(90) for j in range(3)]
    df = spark.createDataFrame(rows, ["market", "lead", "n"])
    kept = {}
    for hot in ("0", "2000000"):
        spark.conf.set("oddsloom.hotRows", hot)
        kept[hot] = sorted(tuple(r) for r in group_stride(df, group="market", stride=4, order=None if kind == "none" else "lead").select("market", "n").collect())
    spark.conf.set("oddsloom.hotRows", "0")
    order = range(90) if kind == "none" else np.argsort(lead)
    want = sorted((f"btc-{i:02d}", j) for i in list(order)[::4] for j in range(3))
    assert kept["0"] == kept["2000000"] == want


def test_calibration_line_is_null_where_no_line_is_best(spark):
    apart = spark.createDataFrame([(0.2, 0), (0.3, 0), (0.7, 1), (0.8, 1)], "p double, y int")
    assert tuple(evaluate.calibration_line(apart, p="p", y="y").first()) == (None, None)
    # A penalty makes the best line finite.
    assert 0 < evaluate.calibration_line(apart, p="p", y="y", ridge=0.1).first().slope < 20


def test_calibration_line_settles_far_from_its_start(spark):
    """Full Newton steps overshoot here; halved ones climb to the line the gradient is zero at."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(9, 1, 400), rng.normal(-9, 1, 400), rng.normal(0, 0.2, 30)])
    y = (rng.random(830) < 1 / (1 + np.exp(-(4 * x - 1)))).astype(int)
    y[0], y[400] = 0, 1
    p = 1 / (1 + np.exp(-x))
    a, b = evaluate.calibration_line(spark.createDataFrame([(float(q), int(t)) for q, t in zip(p, y)], "p double, y int"), p="p", y="y").first()
    z = np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
    rest = y - 1 / (1 + np.exp(-(a + b * z)))
    assert abs(rest.sum()) < 1e-4 and abs((rest * z).sum()) < 1e-3
