import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orderflow.operators import drift as d
from orderflow.operators import profile as p
from orderflow.operators.features import engineer


def stats(df):
    return {r["metric"]: r["value"] if r["text"] is None else r["text"] for r in d.drift_stats(df).collect()}


def snapshot(spark, **values):
    return spark.createDataFrame([(m, v, None) for m, v in values.items()], "metric string, value double, text string")


def found(spark, cur, ref, threshold=0.05):
    got = d.drift_findings(snapshot(spark, **cur), snapshot(spark, **ref), threshold).collect()
    return {r["metric"]: r["relative_delta_pct"] for r in got}


def test_stats_match_pandas(cleaned):
    df = engineer(cleaned)
    pdf = df.toPandas()
    got = stats(df)
    assert got["row_count"] == 5 and got["column_count"] == 34
    for c in ("sales", "profit", "discount"):
        assert got[f"{c}_mean"] == round(pdf[c].mean(), 4)
        assert got[f"{c}_std"] == pytest.approx(pdf[c].std(), abs=1e-4)
        assert got[f"{c}_null_rate"] == 0
    assert (got["unique_customers"], got["unique_products"], got["unique_regions"]) == (3, 4, 4)
    assert (got["order_date_min"], got["order_date_max"]) == ("2015-03-14", "2017-05-30")


def test_text_dates_and_absent_columns_are_left_out(raw):
    got = stats(raw.drop("region", "profit"))
    assert "order_date_min" not in got and "unique_regions" not in got and "profit_mean" not in got


def test_no_numbers_are_missing_values(spark):
    rows = [(1.5, float("nan")), (float("inf"), 2.0), (2.5, None), (float("nan"), 4.0)]
    got = stats(spark.createDataFrame(rows, "sales double, profit double"))
    assert (got["sales_mean"], got["sales_null_rate"], got["sales_std"]) == (2.0, 0.5, 0.7071)
    assert (got["profit_mean"], got["profit_null_rate"]) == (3.0, 0.5)


def test_unchanged_has_no_findings(cleaned):
    s = d.drift_stats(cleaned)
    assert d.drift_findings(s, s).isEmpty()


def test_threshold_is_strict_and_zero_references_are_skipped(spark):
    assert found(spark, {"row_count": 110.0}, {"row_count": 100.0}) == {"row_count": 10.0}
    assert found(spark, {"a": 125.0}, {"a": 100.0}, 0.25) == {}
    assert found(spark, {"a": 5.0}, {"a": 0.0}) == {}
    assert found(spark, {"a": 5.0, "new": 1.0}, {"a": -10.0}) == {"a": 150.0}


def test_undefined_values_are_flagged(spark):
    assert found(spark, {"sales_std": None}, {"sales_std": 3.0}) == {"sales_std": None}


def test_approximate_counts(cleaned):
    got = {r["metric"]: r["value"] for r in d.drift_stats(cleaned, approximate=True).collect()}
    assert got["unique_customers"] == 3


# --- profile -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(
        {
            "skewed": np.where(rng.random(4000) < 0.4, 7.0, rng.lognormal(3, 2, 4000).round(2)),
            "small": rng.integers(0, 5, 4000),
            "gaps": np.where(rng.random(4000) < 0.2, np.nan, rng.normal(0, 1, 4000).round(3)),
            "word": rng.choice(["a", "b", "c"], 4000, p=[0.2, 0.5, 0.3]),
            "flag": rng.random(4000) < 0.3,
        }
    )
    df = spark.createDataFrame(pdf).withColumn("gaps", p.finite(p.F.col("gaps")))
    return df, pdf


def test_columns_match_describe(numbers, stage):
    df, pdf = numbers
    got = {r["column_name"]: r for r in p.profile_columns(df, stage).collect()}
    want = pdf.describe()
    for c in ("skewed", "small", "gaps"):
        for mine, theirs in zip(
            ("count", "mean", "std", "min", "p25", "p50", "p75", "max"),
            ("count", "mean", "std", "min", "25%", "50%", "75%", "max"),
            strict=True,
        ):
            assert got[c][mine] == pytest.approx(want[c][theirs], abs=6e-5), (c, mine)
        assert got[c]["unique"] == pdf[c].nunique()
        assert got[c]["null_count"] == pdf[c].isna().sum()
        assert got[c]["freq"] == pdf[c].value_counts().iloc[0]
    assert (got["word"]["top"], got["word"]["freq"]) == ("b", (pdf.word == "b").sum())
    assert got["flag"]["top"] == "false" and got["flag"]["mean"] is None


def test_quantiles_over_many_small_partitions(spark, stage):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(1001).selectExpr("cast(id AS double) AS v", "1.0D AS same")
        row = {r["column_name"]: r for r in p.profile_columns(df, stage).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [row["v"][k] for k in p.QUARTILES] == [250.0, 500.0, 750.0]
    assert [row["same"][k] for k in p.QUARTILES] == [1.0, 1.0, 1.0]


def test_empty_and_all_null_columns(spark, stage):
    empty = spark.createDataFrame([], "a double, s string")
    rows = {r["column_name"]: r for r in p.profile_columns(empty, stage).collect()}
    assert (rows["a"]["count"], rows["a"]["unique"], rows["a"]["null_rate"]) == (0, 0, None)
    nulls = spark.createDataFrame([(None, None)] * 3, "a double, s string")
    rows = {r["column_name"]: r for r in p.profile_columns(nulls, stage).collect()}
    assert (rows["s"]["null_count"], rows["a"]["null_rate"], rows["a"]["mean"]) == (3, 1.0, None)


def test_approximate_quartiles_are_close(numbers, stage):
    df, pdf = numbers
    got = {r["column_name"]: r for r in p.profile_columns(df, stage, approximate=True).collect()}
    assert got["skewed"]["p50"] == pytest.approx(pdf.skewed.median(), rel=0.02)
    assert (got["skewed"]["top_value"], got["word"]["top"]) == (7.0, "b")
    assert got["skewed"]["unique"] == pytest.approx(pdf.skewed.nunique(), rel=0.1)
    assert got["gaps"]["mean"] == pytest.approx(pdf.gaps.mean(), abs=1e-4)


def test_sketches_stage_nothing(numbers, stage, monkeypatch):
    monkeypatch.setattr(p, "stage_counts", lambda *a: 1 / 0)
    assert p.profile_columns(numbers[0], stage, approximate=True).count() == 5


def test_histogram_matches_numpy(numbers):
    df, pdf = numbers
    got = p.profile_histogram(df, 10, ["skewed", "gaps"]).collect()
    for c in ("skewed", "gaps"):
        want, _ = np.histogram(pdf[c].dropna(), bins=10)
        mine = {r["bin"]: r["rows"] for r in got if r["column_name"] == c}
        assert [mine.get(i, 0) for i in range(10)] == want.tolist()


def test_histogram_of_a_constant(spark):
    rows = p.profile_histogram(spark.createDataFrame([(3.0,), (3.0,)], "x double")).collect()
    assert [(r["bin"], r["rows"]) for r in rows] == [(0, 2)]


def test_correlation_matches_pandas(numbers):
    df, pdf = numbers
    got = p.profile_correlation(df.repartition(5)).collect()
    for r in got:
        want = pdf[[r["left_column"], r["right_column"]]].corr().iloc[0, 1]
        assert r["correlation"] == pytest.approx(want, abs=1e-4)
    assert len(got) == 3


def test_correlation_of_a_constant_is_undefined(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 4.0)], "a double, b double")
    assert p.profile_correlation(df, ["a", "b"]).first()["correlation"] is None


def test_missing_patterns(spark):
    df = spark.createDataFrame([(1, None), (None, None), (2, None), (3, "x")], "a int, b string")
    got = {r["missing_columns"]: r["rows"] for r in p.profile_missing(df).collect()}
    assert got == {"b": 2, "a,b": 1, "": 1}


def test_statistics_merge_to_those_of_all_rows(spark, stage, tmp_path):
    """Batches of one row, without a value, and with far other means; and what a load keeps of them."""
    from test_run import batch

    from orderflow.plans import maintained, run
    from orderflow.sources.lake import FACT, Lake

    whole = batch(spark, list(range(1, 25)))
    cuts = [whole.where("row_id <= 10"), whole.where("row_id = 11"), whole.where("row_id > 11")]
    cuts[0] = cuts[0].withColumn("sales", F.col("sales") * 1e6)
    cuts[1] = cuts[1].withColumns({"profit": F.lit(None).cast("double"), "customer_id": F.lit(None).cast("string")})
    lake = Lake(spark, str(tmp_path))
    assert maintained.statistics(lake) is None
    for n, rows in enumerate(cuts):
        run.load(lake, rows, run.Config(), stage)
        wanted = {r["metric"]: (r["value"], r["text"]) for r in d.drift_stats(lake.read(FACT)).collect()}
        got = {r["metric"]: (r["value"], r["text"]) for r in maintained.statistics(lake).collect()}
        assert got.keys() == wanted.keys()
        for metric, (value, text) in wanted.items():
            assert got[metric][1] == text and (got[metric][0] == value or abs(got[metric][0] - value) <= 1e-4), metric
    # A fact the state does not reach has no statistics to offer.
    run.load_fact(lake, batch(spark, [28]), "row_id")
    assert maintained.statistics(lake) is None


def test_the_most_common_number_is_found_without_a_sort(spark, stage):
    rows = [(1.5, 7, None), (1.5, 7, None), (-2.0, 3, None), (-2.0, 3, None), (9.0, 7, None), (float("nan"), None, None)]
    found = p.profile_columns(spark.createDataFrame(rows, "a double, b int, c double"), stage)
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r["column_name"]: (r["top_value"], r["freq"], r["count"], r["unique"]) for r in found.collect()}
    assert got == {"a": (-2.0, 2, 5, 3), "b": (7.0, 3, 5, 2), "c": (None, None, 0, 0)}
