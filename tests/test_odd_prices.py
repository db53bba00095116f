"""Registered queries against their SQL on prices of zero and above one, and on prices halfway between two roundings."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

HOUR = 3_600


def events():
    kinds = ["click", "view", "purchase", "view", "signup", "error"]
    values = [0.0, 560.0, 120.0, 0.0, 530.0, 75.0, 0.0]
    rows = []
    for i in range(120):
        user, at = i % 2, i // 2
        rows.append((i, pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=at * 1_300 + user), user, kinds[at % 6], values[at % 7], '{"k": %d}' % (at * 7 % 60)))
    return pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"]).astype({"ts": "datetime64[us]"})


def lineitem():
    # 0.0065 and 0.00155 times 110,000: the scaled double lies above or below the half that the decimal digits show.
    rows = [(k, 1, 1 + k % 3, k % 4 * 2 + 1, 17.0, round(17.0 * 110_000 * (0.00105 + 0.0001 * k), 2)) for k in range(400)]
    df = pd.DataFrame(rows, columns=["l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice"])
    df["l_linenumber"] = df["l_linenumber"].astype("int32")
    return df.assign(l_discount=0.05, l_tax=0.02, l_returnflag="N", l_linestatus="O", l_shipdate=pd.Timestamp("1996-01-01").as_unit("us"))


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    events().to_parquet(path / "events.parquet", index=False)
    lineitem().to_parquet(path / "lineitem.parquet", index=False)
    return str(path)


@pytest.mark.parametrize("name", [
    "brier_advantage",
    "total_brier_advantage",
    "mark_to_market_pnl",
    "sized_entries",
    "trailing_trade_features",
    "opening_features",
    "stream_trailing_features",
])
def test_query_follows_its_sql(spark, folder, name):
    got = entry.queries()[name](spark, folder)
    con = duckdb.connect()
    for table in ("events", "lineitem"):
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want = [tuple(plain(v) for v in r) for r in cursor.fetchall()]
    assert want
    assert sorted((tuple(plain(v) for v in r) for r in got.select(*columns).collect()), key=repr) == sorted(want, key=repr)
