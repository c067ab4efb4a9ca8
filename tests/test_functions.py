import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orderflow.functions import (
    exact_mean,
    exact_sum,
    guarded_ratio,
    na_to_null,
    round_half_even,
    strip,
    title_case,
    zip5,
)
from orderflow.functions.text import NA_TOKENS, WHITESPACE


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def apply(spark, fn, values, kind="string"):
    df = column(spark, values, kind).select("i", fn(F.col("v")).alias("v"))
    return [r["v"] for r in sorted(df.collect())]


def test_strip_matches_python(spark):
    values = ["\t  Garden tools", "Wholesale \t", " x ", "a b", "", "   ", None]
    want = [v if v is None else v.strip() for v in values]
    assert apply(spark, strip, values) == want


def test_strip_of_texts_that_only_look_done(spark):
    values = ["\x1fa", "a\x85", "\xa0 b \u3000", " \u2003 c", "é \t", "\x7fd\x7f", "~", "! !", "\u3000", " \n"]
    assert apply(spark, strip, values) == [v.strip() for v in values]


def test_whitespace_is_what_python_strips():
    assert set(WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_title_case_known(spark):
    values = ["furniture", "CONSUMER", "eAsT", "first-class", "mcdonald's", "4-NOT SPECIFIED",
              "a  b", "tab\there", "x1y2", "", None, "éCOLE naïve"]
    want = [v if v is None else v.title() for v in values]
    assert apply(spark, title_case, values) == want


def test_title_case_behind_marks(spark):
    values = ["BRAND#7", "7UP", "A-b C", "A -B", "#\u01c5A", "x#\u00c9A", "'TIS O'NEIL", "12 AB 3"]
    want = ["Brand#7", "7Up", "A-B C", "A -B", "#\u01c5a", "X#\u00c9a", "'Tis O'Neil", "12 Ab 3"]
    assert apply(spark, title_case, values) == want


# Latin-1 text without the sharp s, the micro sign and the ordinals, which have no one-letter
# title case inside Latin-1 or count as letters in Python only.
latin = st.text(
    st.characters(max_codepoint=255, exclude_characters="\x00\xdf\xb5\xaa\xba"), max_size=12
)


@settings(max_examples=8, deadline=None)
@given(st.lists(latin, min_size=50, max_size=80))
def test_title_case_property(spark, values):
    assert apply(spark, title_case, values) == [v.title() for v in values]


def test_zip5(spark):
    values = ["7094", "83714", "83714.0", "1234567", "AB1", "94.05", None, "0"]
    want = ["07094", "83714", "83714", "1234567", "AB1", "94.05", None, "00000"]
    assert apply(spark, zip5, values) == want
    assert apply(spark, zip5, [83714.0], "double") == ["83714"]


def test_zip5_keeps_what_the_pattern_took(spark):
    values = ["12.0\n", "1.0.0", ".0", "1.02.0", "12\n", "123456.0", ""]
    assert apply(spark, zip5, values) == ["0012\n", "1.0", "", "1.02", "0012\n", "123456", ""]


def test_na_tokens(spark):
    assert apply(spark, na_to_null, [*NA_TOKENS, "x"]) == [None] * len(NA_TOKENS) + ["x"]


def test_round_half_even_is_numpy(spark):
    rng = np.random.default_rng(1)
    values = [1.005, 0.125, 2.675, -0.125, 0.5, 1.5, None, *rng.uniform(-1e6, 1e6, 500).tolist()]
    for scale in (0, 1, 2, 4):
        want = [None if v is None else float(np.round(v, scale)) for v in values]
        assert apply(spark, lambda c, s=scale: round_half_even(c, s), values, "double") == want


def test_guarded_ratio(spark):
    df = spark.createDataFrame([(1, 100.0, 4), (2, 5.0, 0), (3, 5.0, None)], "i int, a double, b long")
    got = df.select("i", guarded_ratio(F.col("a"), F.col("b")).alias("v"))
    assert [r["v"] for r in sorted(got.collect())] == [25.0, 0.0, None]


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_exact_sum_does_not_depend_on_partitions(spark, parts):
    rng = np.random.default_rng(2)
    cents = rng.integers(-10**9, 10**9, 4000)
    df = column(spark, [int(c) / 100 for c in cents], "double").repartition(parts)
    row = df.agg(exact_sum(F.col("v")).alias("s"), exact_mean(F.col("v")).alias("m")).first()
    assert row["s"] == int(cents.sum()) / 100
    assert row["m"] == int(cents.sum()) / 100 / 4000


def test_exact_sum_over_nothing(spark):
    row = column(spark, [None], "double").agg(
        exact_sum(F.col("v")).alias("s"), exact_mean(F.col("v")).alias("m")
    )
    assert tuple(row.first()) == (0.0, None)


def test_sums_keep_what_lies_below_a_millionth(spark):
    df = spark.range(1000).selectExpr("4e-7D AS x", "CAST(id AS double) * 1e-9 AS y", "IF(id = 3, double('NaN'), 0.1D) AS z")
    row = df.agg(exact_sum(df.x).alias("x"), exact_sum(df.y).alias("y"), exact_sum(df.z).alias("z"), exact_mean(df.z).alias("m")).first()
    assert row["x"] == pytest.approx(4e-4, rel=1e-9) and row["y"] == pytest.approx(4.995e-4, rel=1e-9)
    assert (row["z"], row["m"]) == (99.9, 0.1)


def test_sums_do_not_depend_on_the_order(spark):
    df = spark.range(4000).selectExpr("(id * 7919 % 1000 - 300) * pow(10.0, id % 9 - 5) AS x")
    sums = {df.repartition(n).agg(exact_sum(F.col("x"))).first()[0] for n in (1, 3, 8)}
    assert len(sums) == 1
