"""Brier advantages against their SQL: hours without a price, and sums halfway between two roundings."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

# Sums of these hours' advantages at the half of the sixth place: the scaled double lies beside the half that the digits show, or on it.
CENTS = [1_000_025, 37_525, 0.0, 12_475, 25.0, 1_275]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path, rows = tmp_path_factory.mktemp("brier"), []
    for i in range(400):
        user, hour = i % 2, i // 4
        value = None if hour % 7 in (0, 3) or (hour % 7 == 5 and user) else (CENTS[hour % 6] + i * 25) / 100
        rows += [(2 * i + k, pd.Timestamp("2024-01-01") + pd.Timedelta(hours=hour, seconds=i), user, kind, price, '{"k": 1}')
                 for k, (kind, price) in enumerate([("click", value), ("purchase", None if value is None else value / 4)])]
    df = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"]).astype({"ts": "datetime64[us]"})
    df.to_parquet(path / "events.parquet", index=False)
    return str(path)


@pytest.mark.parametrize("name", ["brier_advantage", "total_brier_advantage"])
def test_brier_follows_its_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(cursor.fetchall(), key=repr)
    assert any(r[-2] is None for r in want)
    assert sorted((tuple(r) for r in entry.queries()[name](spark, folder).select(*columns).collect()), key=repr) == want
