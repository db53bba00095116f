"""Samples of the fits come in groups, a customer's month each, and a part of a fit holds whole groups only."""

from collections import Counter
from datetime import datetime, timedelta

import pytest

from oddsloom.ml import direction as md
from oddsloom.plans import load_catalog


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Three orders a month of each of eight customers over seven years: on days that windows begin and end between."""
    path = tmp_path_factory.mktemp("orders")
    days = [(c, datetime(1995 + m // 12, m % 12 + 1, 1) + timedelta(days=d)) for c in range(8) for m in range(84) for d in (c, c + 9, c + 18)]
    orders = [(i, c, 1000.0 + i * 7919 % 450_000, at, f"{i % 5 + 1}-LEVEL") for i, (c, at) in enumerate(days)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(c, "MACHINERY"[: c + 1]) for c in range(8)], "c_custkey bigint, c_mktsegment string").write.parquet(f"{path}/customer.parquet")
    return str(path), {key: (c, at.year, at.month) for key, c, _, at, _ in orders}


@pytest.fixture
def parts(monkeypatch):
    seen = []

    def fit(train, calibrate, test, **_):
        seen.extend([r.sample_id for r in part.collect()] for part in (train, calibrate, test))
        return test.withColumn("p_up", test["price"])

    monkeypatch.setattr(md, "_fit_and_score", fit)
    return seen


def check(spark, folder, parts, name):
    path, month = folder
    size = Counter(month.values())
    found = load_catalog()[name].build(spark, path)
    assert len(parts) >= 3 and all(parts)
    for part in parts:
        # All samples of a customer's month, or none.
        assert all(n == size[group] for group, n in Counter(month[key] for key in part).items())
    return found, month


def test_sealed_parts_hold_whole_groups(spark, folder, parts):
    found, month = check(spark, folder, parts, "sealed_holdout_predictions")
    # The sealed part begins on 9 June 2001, within a month of every customer: all of that month is sealed.
    assert {r.sample_id for r in found.collect()} == {key for key, (_, y, m) in month.items() if (y, m) >= (2001, 6)}


def test_fold_parts_hold_whole_groups(spark, folder, parts):
    check(spark, folder, parts, "walk_forward_predictions")
