"""The parts of a fit, read once a Newton step, come from a written table and not through a join; their rows are those of the windows."""

import pytest

from oddsloom.ml import direction as md
from oddsloom.operators.dataset import walk_forward

DAY = 86_400 * 10**9


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(i, f"g{i // 2}", i // 2 * DAY, (i // 2 + 1) * DAY, float(i % 5), float(i % 3 == 0), 1.0) for i in range(240)]
    return spark.createDataFrame(rows, "sample_id bigint, group_id string, feature_ts bigint, label_available_ts bigint, x double, y double, w double")


@pytest.fixture
def parts(monkeypatch):
    seen = []

    def fit(train, calibrate, test, **_):
        for part in (train, calibrate, test):
            plan = part._jdf.queryExecution().optimizedPlan().toString()
            assert "Join" not in plan and "Aggregate" not in plan
            # Only the part's own folder is read.
            assert "PartitionFilters: [isnotnull(" in part._jdf.queryExecution().executedPlan().toString()
            seen.append(sorted(r.sample_id for r in part.collect()))
        return test.withColumn("p_up", test["x"])

    monkeypatch.setattr(md, "_fit_and_score", fit)
    return seen


COMMON = dict(features=["x"], label="y", weight="w")


def test_sealed_parts_are_written(samples, parts):
    folds = walk_forward(samples, train=30 * DAY, calibration=20 * DAY, test=10 * DAY, step=10 * DAY, embargo=2 * DAY, holdout=15 * DAY)
    out = md.sealed_holdout(
        samples, folds, feature_ts="feature_ts", label_ts="label_available_ts", group="group_id", train_ns=30 * DAY, calibration_ns=20 * DAY, embargo_ns=2 * DAY, **COMMON
    )
    # Days 104 to 119 are sealed; calibration ends on day 102, training on day 80, and labels are known a day later.
    days = lambda a, b: list(range(2 * a, 2 * b))
    assert parts == [days(50, 80), days(82, 102), days(104, 120)] and out.columns == ["sample_id", "p_up", "y", "w"]
    assert out.count() == 32


def test_fold_parts_are_written(samples, parts):
    folds = walk_forward(samples, train=30 * DAY, calibration=20 * DAY, test=10 * DAY, step=10 * DAY, embargo=2 * DAY, holdout=15 * DAY)
    out = md.out_of_fold(samples, folds, **COMMON)
    assert len(parts) % 3 == 0 and parts[:3] == [list(range(0, 60)), list(range(64, 104)), list(range(108, 128))]
    assert out.columns == ["fold", "sample_id", "p_up", "y", "w"] and out.count() == 20 * len(parts) // 3
