import pandas as pd
import pytest
from pyspark.sql import functions as F

from orderflow.operators.features import engineer
from orderflow.plans import gold, serve
from orderflow.sources.conformed import conformed_sales

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fact(spark):
    return engineer(conformed_sales(spark, SF)).persist()


@pytest.fixture(scope="module")
def pdf(fact):
    return fact.toPandas()


def brute(pdf, table):
    """The table as pandas computes it."""
    measures = {
        "total_sales": ("sales", "sum", 2),
        "total_profit": ("profit", "sum", 2),
        "total_units": ("quantity", "sum", 0),
        "total_orders": ("order_id", "nunique", 0),
        "total_customers": ("customer_id", "nunique", 0),
        "total_rows": ("row_id", "count", 0),
        "avg_discount": ("discount", "mean", 4),
        "avg_order_value": ("sales", "mean", 2),
        "avg_profit_margin": ("profit_margin_pct", "mean", 2),
    }
    agg = pdf.groupby(list(table.keys)).agg(**{m: measures[m][:2] for m in table.measures})
    return agg.round({m: measures[m][2] for m in table.measures}).reset_index()


@pytest.mark.parametrize("table", gold.GOLD, ids=lambda t: t.name)
def test_tables_match_pandas(fact, pdf, table):
    mine = gold.build(table, fact).toPandas()
    want = brute(pdf, table)
    assert list(mine.columns) == table.columns
    keys = list(table.keys)
    pd.testing.assert_frame_equal(
        mine.sort_values(keys).reset_index(drop=True),
        want[table.columns].sort_values(keys).reset_index(drop=True),
        check_dtype=False,
        atol=0.0101,  # a sum that is exactly half a cent can round either way
        rtol=1e-9,
    )


@pytest.mark.parametrize("table", gold.GOLD, ids=lambda t: t.name)
def test_shared_roll_up_gives_the_same_tables(fact, table):
    shared = gold.all_tables(fact)[table.name]
    assert shared.exceptAll(gold.build(table, fact)).isEmpty()
    assert shared.count() == gold.build(table, fact).count()


def test_null_keys_are_left_out_and_null_measures_are_zero(spark):
    rows = [("East", 1, "O1", None, None, None, None), (None, 2, "O2", 1.0, 1.0, 0.0, 1.0)]
    df = spark.createDataFrame(
        rows, "region string, row_id long, order_id string, sales double, profit double, discount double, profit_margin_pct double"
    ).withColumn("quantity", F.lit(None).cast("bigint"))
    assert [tuple(r) for r in gold.sales_by_region(df).collect()] == [("East", 0.0, 0.0, 1, 1, None, None)]


def test_an_order_with_a_third_of_all_lines_counts_once(fact):
    hot = fact.limit(1).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(3000))))
    lines = fact.unionByName(hot.drop("copy"))
    mine = gold.sales_by_region(lines).agg(F.sum("total_orders")).first()[0]
    assert mine == gold.sales_by_region(fact).agg(F.sum("total_orders")).first()[0]
    assert gold.sales_by_region(lines).agg(F.sum("total_rows")).first()[0] == fact.count() + 3000


def test_sorting(fact):
    sales = [r["total_sales"] for r in gold.product_performance(fact).collect()]
    assert sales == sorted(sales, reverse=True)
    months = [(r["order_year"], r["order_month"]) for r in gold.monthly_trends(fact).collect()]
    assert months == sorted(months)


# --- reports -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tables(fact):
    return {t.name: gold.build(t, fact).persist() for t in gold.GOLD}


def test_regions_hide_the_row_count(tables):
    df = serve.regions(tables["sales_by_region"])
    assert "total_rows" not in df.columns
    sales = [r["total_sales"] for r in df.collect()]
    assert sales == sorted(sales, reverse=True)


def test_year_filter_and_bounds(tables):
    gold_months = tables["monthly_trends"]
    assert serve.monthly(gold_months, 2000, (1995, 2001)).count() == 12
    assert serve.monthly(gold_months, 2015).count() == 0
    assert serve.monthly(gold_months).count() == gold_months.count()
    with pytest.raises(ValueError, match="year"):
        serve.monthly(gold_months, 9999)


def test_top_products_limits(tables):
    gold_products = tables["product_performance"]
    assert serve.top_products(gold_products, 3).count() == 3
    assert len(serve.top_products(gold_products).columns) == 8
    for bad in (0, 101):
        with pytest.raises(ValueError, match="limit"):
            serve.top_products(gold_products, bad)


def test_equal_totals_are_put_in_one_order_by_all_keys(spark):
    rows = [("P", f"name {i % 3}", f"c{i % 2}", f"s{i}", 10.0, -1.0, 1, 0.1, 5.0, 2) for i in range(12)]
    names = "product_id string, product_name string, category string, sub_category string, total_sales double, " \
        "total_profit double, total_orders long, avg_discount double, avg_profit_margin double, total_units long"
    df = spark.createDataFrame(rows, names)
    for report in (serve.top_products_rounded, serve.bottom_products, serve.loss_products, serve.top_products):
        picks = {tuple(map(tuple, report(df.repartition(n), 5).collect())) for n in (1, 3, 7)}
        assert len(picks) == 1


def test_top_n_is_not_a_full_sort(tables):
    plan = serve.top_products(tables["product_performance"])._jdf.queryExecution().executedPlan()
    assert "TakeOrderedAndProject" in plan.toString()


def test_seasonality_lists_all_months(spark):
    months = spark.createDataFrame(
        [(2016, 11, 10.0), (2017, 11, 20.0), (2017, 1, 5.0)], "order_year long, order_month long, total_sales double"
    )
    rows = serve.seasonality(months).collect()
    assert [r["order_month_name"] for r in rows] == list(serve.MONTHS)
    assert (rows[0]["mean_sales"], rows[1]["mean_sales"], rows[10]["mean_sales"]) == (5.0, None, 15.0)


def test_loss_reports(spark):
    df = spark.createDataFrame(
        [("F", "Tables", 10.4, -5.5, 0.155), ("F", "Chairs", 20.0, 3.0, 0.1), ("T", "Machines", 7.0, -9.0, 0.3)],
        "category string, sub_category string, total_sales double, total_profit double, avg_discount double",
    )
    rows = serve.loss_sub_categories(df).collect()
    assert [(r["sub_category"], r["total_sales"], r["avg_discount_pct"]) for r in rows] == [
        ("Machines", 7.0, 30.0),
        ("Tables", 10.0, 15.5),
    ]


@pytest.mark.parametrize("table", gold.GOLD, ids=lambda t: t.name)
def test_a_merge_reads_the_state_and_the_batch_alone(spark, stage, table):
    """No file of the fact is in the plan, and the state's pairs are not shuffled for a small batch."""
    from orderflow.plans import maintained

    wide = spark.range(3000).select(
        F.col("id").alias("row_id"), F.concat(F.lit("o"), F.col("id") % 900).alias("order_id"),
        F.concat(F.lit("c"), F.col("id") % 70).alias("customer_id"), F.concat(F.lit("r"), F.col("id") % 4).alias("region"),
        F.concat(F.lit("s"), F.col("id") % 3).alias("segment"), F.concat(F.lit("p"), F.col("id") % 300).alias("product_id"),
        F.lit("n").alias("product_name"), F.concat(F.lit("k"), F.col("id") % 5).alias("category"), F.lit("u").alias("sub_category"),
        F.lit(2017).cast("bigint").alias("order_year"), (F.col("id") % 12).alias("order_month"), F.lit("x").alias("order_month_name"),
        (F.col("id") / 7).alias("sales"), (F.col("id") / 70).alias("profit"), F.lit(0.1).alias("discount"),
        F.lit(3.5).alias("profit_margin_pct"), F.lit(2).cast("bigint").alias("quantity"),
    )
    old, new = stage.put("fact", wide.where("id % 10 < 9")), stage.put("batch", wide.where("id % 10 = 9 OR id < 0"))
    parts = gold.line_parts(old)
    pairs = {c: stage.put(c, maintained.distinct_pairs(table, parts, c)) for c in table.distinct_ids}
    sums = stage.put("sums", maintained.counted(table, None, parts, pairs))
    after = gold.line_parts(new)
    fresh = {c: maintained.unseen(maintained.distinct_pairs(table, after, c), pairs[c]) for c in pairs}
    merged = table.from_sums(maintained.counted(table, sums, after, fresh))
    assert not [f for f in merged.inputFiles() if f"/{'fact'}/" in f]
    key = lambda rows: sorted(map(tuple, rows), key=str)
    assert key(merged.collect()) == key(table.from_parts(gold.line_parts(wide)).collect())
