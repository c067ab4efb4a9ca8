import pytest
from conftest import ROWS, changed, make

from orderflow.operators import quality as q
from orderflow.operators.clean import clean


def report(df, **kwargs):
    return {r["check_name"]: r for r in q.quality_report(df, **kwargs).collect()}


def failing(df, **kwargs):
    return {n: (r["failures"], r["details"]) for n, r in report(df, **kwargs).items() if not r["passed"]}


def test_good_rows_pass_five_and_six_checks(raw, cleaned):
    assert len(report(raw)) == 5 and not failing(raw)
    assert len(report(cleaned, date_checks=True)) == 6 and not failing(cleaned, date_checks=True)


def test_missing_columns(raw):
    got = failing(raw.drop("sales", "profit"))
    assert got == {"schema_columns": (2, "missing columns: ['profit', 'sales']")}


def test_nulls_count_columns_and_no_number_counts_as_null(spark):
    rows = [list(x) for x in changed(3, customer_id=None)]
    rows[0][20], rows[2][20], rows[4][20] = None, float("nan"), float("-inf")
    assert failing(make(spark, rows)) == {"null_check": (2, "customer_id: 1 nulls; profit: 3 nulls")}


def test_ranges_are_strict(spark):
    rows = changed(2, sales=-0.01, discount=1.01, quantity=-4)
    text = (
        "sales: 1 rows below min 0.0; quantity: 1 rows below min 1; discount: 1 rows above max 1.0"
    )
    assert failing(make(spark, rows)) == {"value_ranges": (3, text)}
    assert not failing(make(spark, changed(2, sales=0.0, discount=1.0, quantity=1)))


def test_unexpected_values_are_counted_whole_and_all_of_them_kept(spark):
    rows = [list(x) for x in changed(0, region="Overseas", category="Toys")]
    rows[1][12], rows[2][12], rows[3][12] = "Overseas", None, "Islands"
    text = "region: 2 unexpected values in 3 rows; category: 1 unexpected values in 1 rows"
    assert failing(make(spark, rows))["allowed_values"] == (2, text)
    many = make(spark, [(i, *ROWS[0][1:12], f"R{i % 250:04d}", *ROWS[0][13:]) for i in range(500)])
    assert failing(many)["allowed_values"] == (1, "region: 250 unexpected values in 500 rows")
    found = q.rogue_values(many, list(q.DEFAULT_SCHEMA.rules)).collect()
    assert len(found) == 250 and {r["rows"] for r in found} == {2}


def test_duplicates(spark):
    df = make(spark, ROWS + ROWS[:2])
    assert failing(df) == {"duplicate_rows": (2, "2 fully-duplicated rows detected")}
    assert not failing(df, duplicate_rows=0)


def test_ship_before_order(spark, raw):
    df = clean(make(spark, changed(0, ship_date="3/13/2015")))
    got = failing(df, date_checks=True)
    assert got == {"ship_after_order": (1, "1 rows where ship_date < order_date")}
    count, details = failing(raw, date_checks=True)["ship_after_order"]
    assert count == 0 and "parsed" in details


def test_summary_and_gate(spark, raw):
    bad = q.quality_report(make(spark, changed(0, region="Overseas")))
    assert tuple(q.summarise(bad).first()) == (5, 4, 1, False)
    assert tuple(q.summarise(q.quality_report(raw)).first()) == (5, 5, 0, True)
    with pytest.raises(q.QualityGateError, match="raw data: allowed_values"):
        q.gate(bad, "raw")
    outcome = q.gate(bad, "raw", fail_on_error=False)
    assert (outcome["passed"], outcome["total_checks"], outcome["failed_checks"]) == (False, 5, 1)


def test_empty_frame_passes(raw):
    assert not failing(raw.limit(0))
