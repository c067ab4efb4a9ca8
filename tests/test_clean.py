import datetime as dt

import pytest
from conftest import ROWS, changed, make
from pyspark.sql import functions as F

from orderflow.operators import clean as c
from orderflow.operators import dedup
from orderflow.schema import DEFAULT_SCHEMA


def values(df, name):
    return [r[name] for r in df.orderBy("row_id").collect()]


def test_clean_types_and_values(cleaned):
    kinds = dict(cleaned.dtypes)
    assert kinds["order_date"] == kinds["ship_date"] == "date"
    assert kinds["row_id"] == kinds["quantity"] == "bigint"
    assert kinds["sales"] == kinds["discount"] == kinds["profit"] == "double"
    assert values(cleaned, "order_date")[0] == dt.date(2015, 3, 14)
    assert values(cleaned, "postal_code") == ["70112", "70112", "02139", "60614", None]
    assert cleaned.columns == DEFAULT_SCHEMA.names


def test_strip_keeps_nulls(spark):
    df = make(spark, changed(0, category="\tTechnology", segment=" Home Office\n ", city=None))
    row = c.strip_whitespace(df).filter("row_id = 1").first()
    assert (row["category"], row["segment"], row["city"]) == ("Technology", "Home Office", None)


def test_categoricals_are_title_cased_and_absent_ones_skipped(spark, raw):
    df = make(spark, changed(0, category="oFFICE sUPPLIES", segment="home OFFICE", region="cenTRAL"))
    row = c.normalise_categoricals(df).filter("row_id = 1").first()
    assert (row["category"], row["segment"], row["region"]) == ("Office Supplies", "Home Office", "Central")
    assert "state" not in c.normalise_categoricals(raw.drop("state")).columns


@pytest.mark.parametrize("bad", ["14 March", "3/14/15", "3/14/2015 12:30", "2015-03-14", "13/1/2015"])
def test_bad_dates_raise(spark, bad):
    with pytest.raises(Exception, match="CAST_INVALID|CANNOT_PARSE|parsed|DateTime|INCONSISTENT"):
        c.parse_dates(make(spark, changed(0, order_date=bad))).collect()


def test_padded_and_plain_dates_agree(spark):
    df = make(spark, changed(2, order_date="04/09/2016"))
    assert values(c.parse_dates(df), "order_date")[2] == dt.date(2016, 4, 9)


def test_numbers_are_coerced(spark):
    df = spark.createDataFrame(
        [(1, "1,000", "2"), (2, "12.5", "2.0"), (3, "nan", "3.7"), (4, None, "x"), (5, "1e3", "9007199254740993")],
        "i int, sales string, quantity string",
    )
    got = [tuple(r)[1:] for r in sorted(c.cast_numerics(df).collect())]
    assert got == [(None, 2), (12.5, 2), (None, None), (None, None), (1000.0, 9007199254740993)]


def test_numbers_that_are_none_become_null_and_long_ids_keep_their_digits(spark):
    rows = [("inf", "9007199254740993.0"), ("-Infinity", "1e300"), ("1e19", " 12.000 "), ("9e18", "12.5"), ("NaN", "-7.")]
    df = spark.createDataFrame(rows, "sales string, quantity string")
    got = [tuple(r) for r in c.cast_numerics(df).collect()]
    assert got == [(None, 9007199254740993), (None, None), (None, 12), (9e18, None), (None, -7)]


def test_full_duplicates_are_dropped(spark):
    df = make(spark, ROWS + ROWS[:2])
    assert dedup.duplicate_count(df).first()["duplicate_rows"] == 2
    assert dedup.count_duplicates(df) == 2
    assert c.clean(df).count() == 5


def test_duplicates_that_appear_only_after_normalising(spark):
    twin = list(ROWS[0])
    twin[DEFAULT_SCHEMA.names.index("region")] = " south"
    df = make(spark, [*ROWS, tuple(twin)])
    assert dedup.count_duplicates(df) == 0
    assert c.clean(df).count() == 5


def test_no_repeat_is_proved_without_the_wide_step(raw):
    assert not dedup.has_repeated_fingerprint(raw)
    assert dedup.count_duplicates(raw) == 0


def test_signed_zeros_count_as_equal(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (None,), (None,)], "x double")
    assert dedup.count_duplicates(df) == 2
    assert dedup.drop_full_duplicates(df).count() == 2


def test_a_hot_set_of_copies_is_reduced_before_the_shuffle(raw):
    plan = raw.dropDuplicates()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2


def test_row_steps_need_no_shuffle(raw):
    plan = c.cast_numerics(c.normalise(raw))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PythonUDF" not in plan


def test_clean_does_not_change_its_input(raw):
    before = raw.collect()
    c.clean(raw).collect()
    assert raw.collect() == before
    assert raw.filter(F.col("order_date") == "3/14/2015").count() == 2
