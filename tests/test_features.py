import datetime as dt

import pytest

from orderflow.operators import features as f
from orderflow.schema import DERIVED


def money(spark, rows):
    df = spark.createDataFrame(rows, "i int, sales double, profit double, discount double, quantity long")
    return sorted(f.add_financial_features(df).collect())


def test_all_derived_columns_in_order(cleaned):
    df = f.engineer(cleaned)
    assert df.columns == [*cleaned.columns, *DERIVED]
    assert df.count() == cleaned.count()


def test_calendar(spark):
    days = [(1, dt.date(2016, 11, 8), dt.date(2016, 11, 11)), (2, dt.date(2017, 1, 1), dt.date(2016, 12, 30)), (3, None, None)]
    df = f.add_time_features(spark.createDataFrame(days, "i int, order_date date, ship_date date"))
    got = [tuple(r)[3:] for r in sorted(df.collect())]
    assert got == [(2016, 11, "Nov", 4, 1, 3), (2017, 1, "Jan", 1, 6, -2), (None,) * 6]
    assert all(kind == "bigint" for name, kind in df.dtypes[3:] if name != "order_month_name")


def test_margin_and_zero_sales(spark):
    rows = money(spark, [(1, 200.0, 50.0, 0.1, 4), (2, 0.0, 10.0, 0.1, 1), (3, None, 1.0, 0.0, 1)])
    assert [r["profit_margin_pct"] for r in rows] == [25.0, 0.0, None]
    assert [r["discount_amount"] for r in rows] == [20.0, 0.0, None]


def test_per_unit_with_zero_and_null_quantity(spark):
    rows = money(spark, [(1, 100.0, 10.0, 0.0, 4), (2, 100.0, 10.0, 0.0, 0), (3, 100.0, 10.0, 0.0, None)])
    assert [r["revenue_per_unit"] for r in rows] == [25.0, 0.0, None]
    assert [r["profit_per_unit"] for r in rows] == [2.5, 0.0, None]


def test_profitable_flag(spark):
    rows = money(spark, [(1, 1.0, 1.0, 0.0, 1), (2, 1.0, 0.0, 0.0, 1), (3, 1.0, -1.0, 0.0, 1), (4, 1.0, None, 0.0, 1)])
    assert [r["is_profitable"] for r in rows] == [True, False, False, False]


@pytest.mark.parametrize(
    ("margin", "tier"),
    [(-15.0, "Loss"), (0.0, "Low"), (9.99, "Low"), (10.0, "Medium"), (19.99, "Medium"), (20.0, "High"), (25.0, "High"), (None, "Unknown")],
)
def test_tiers(spark, margin, tier):
    df = spark.createDataFrame([(margin,)], "m double")
    assert df.select(f.profit_tier(df.m)).first()[0] == tier


def test_speeds(spark):
    want = {-2: "Same Day", 0: "Same Day", 1: "Same Day", 2: "Express", 3: "Express", 4: "Standard", 6: "Standard", 7: "Slow", None: "Unknown"}
    df = spark.createDataFrame([(d,) for d in want], "d long")
    assert [r[0] for r in df.select(f.shipping_speed(df.d)).collect()] == list(want.values())


def test_no_shuffle_and_no_python(cleaned, raw):
    plan = f.engineer(raw.transform(lambda d: d.withColumns({"order_date": d.order_date.try_cast("date"), "ship_date": d.ship_date.try_cast("date")})))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text
