"""Months between a key's returns are filled beside them, without a join to a calendar."""

import datetime

from oddsloom.operators import portfolio as pf


def test_months_without_returns_need_no_calendar(spark, rows):
    day = lambda y, m: datetime.date(y, m, 1)
    data = [(1, day(2020, 11), 0.5), (1, day(2020, 11), 1.0), (1, day(2021, 2), -0.5), (2, day(2021, 1), None), (3, None, 0.5), (3, day(2021, 5), 0.25)]
    out = pf.compounded(spark.createDataFrame(data, "k int, month date, ret double"), keys=["k"], month="month")
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(rows(out, "k", "month", "ret")) == [
        (1, day(2020, 11), 2.0), (1, day(2020, 12), 0.0), (1, day(2021, 1), 0.0), (1, day(2021, 2), -0.5), (2, day(2021, 1), 0.0), (3, day(2021, 5), 0.25),
    ]
    table = pf.year_month_table(out, keys=["k"], month="month")
    assert sorted(rows(table, "k", "year", "m01", "m02", "m05", "m11", "m12")) == [
        (1, 2020, None, None, None, 200.0, 0.0), (1, 2021, 0.0, -50.0, None, None, None), (2, 2021, 0.0, None, None, None, None), (3, 2021, None, None, 25.0, None, None),
    ]
    # One aggregate per year: a pivot aggregates by month first.
    assert table._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2
