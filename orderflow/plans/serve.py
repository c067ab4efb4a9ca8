"""Reports over the aggregate tables.  Each takes DataFrames and returns one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.functions import exact_sum, round_half_even
from orderflow.operators.rows import sample_rows

MONTHS = tuple("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())
# All keys of the product table: equal totals are put in an order that no partitioning changes.
PRODUCT_KEYS = ("product_id", "product_name", "category", "sub_category")
YEAR_BOUNDS = (2014, 2017)
LIMIT_BOUNDS = (1, 100)


def _within(name: str, value: int, bounds: tuple[int, int]) -> int:
    low, high = bounds
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}, got {value}")
    return value


def _rounded(name: str, scale: int, alias: str | None = None) -> Column:
    return round_half_even(F.col(name), scale).alias(alias or name)


def regions(gold: DataFrame) -> DataFrame:
    """Regions without the line count, best seller first."""
    return gold.drop("total_rows").orderBy(F.desc("total_sales"), "region")


def monthly(
    gold: DataFrame, year: int | None = None, bounds: tuple[int, int] = YEAR_BOUNDS
) -> DataFrame:
    """Months in order, of one year if given; a year without data gives no rows."""
    if year is not None:
        gold = gold.filter(F.col("order_year") == _within("year", year, bounds))
    return gold.orderBy("order_year", "order_month")


def top_products(
    gold: DataFrame, limit: int = 10, bounds: tuple[int, int] = LIMIT_BOUNDS
) -> DataFrame:
    """Best-selling products."""
    return (
        gold.select(
            "product_id",
            "product_name",
            "category",
            "sub_category",
            "total_sales",
            "total_profit",
            "total_orders",
            "avg_profit_margin",
        )
        .orderBy(F.desc("total_sales"), *PRODUCT_KEYS)
        .limit(_within("limit", limit, bounds))
    )


def segments(gold: DataFrame) -> DataFrame:
    return gold.orderBy(F.desc("total_sales"), "segment")


def regional_performance(gold: DataFrame) -> DataFrame:
    return gold.orderBy(F.desc("total_sales"), "region").select(
        "region",
        _rounded("total_sales", 0),
        _rounded("total_profit", 0),
        "total_orders",
        _rounded("avg_profit_margin", 2, "avg_profit_margin_pct"),
    )


def regions_by_profit(gold: DataFrame) -> DataFrame:
    return gold.orderBy(F.desc("total_profit"), "region").select(
        "region", "total_sales", "total_profit"
    )


def top_sub_categories(gold: DataFrame, limit: int = 10) -> DataFrame:
    return (
        gold.orderBy(F.desc("total_sales"), "category", "sub_category")
        .limit(limit)
        .select(
            "category",
            "sub_category",
            _rounded("total_sales", 0),
            _rounded("total_profit", 0),
            _rounded("avg_profit_margin", 2, "margin_pct"),
        )
    )


def loss_sub_categories(gold: DataFrame) -> DataFrame:
    """Sub-categories with a loss, worst first."""
    return (
        gold.filter(F.col("total_profit") < 0)
        .orderBy("total_profit", "category", "sub_category")
        .select(
            "category",
            "sub_category",
            _rounded("total_sales", 0),
            _rounded("total_profit", 0),
            round_half_even(F.col("avg_discount") * 100, 1).alias("avg_discount_pct"),
        )
    )


def most_profitable_sub_categories(gold: DataFrame, limit: int = 5) -> DataFrame:
    return (
        gold.orderBy(F.desc("total_profit"), "category", "sub_category")
        .limit(limit)
        .select("sub_category", _rounded("total_profit", 2, "profit"))
    )


def segment_kpis(gold: DataFrame) -> DataFrame:
    return gold.orderBy(F.desc("total_sales"), "segment").select(
        "segment",
        "total_customers",
        "total_orders",
        _rounded("total_sales", 0),
        _rounded("total_profit", 0),
        _rounded("avg_order_value", 2),
        _rounded("avg_profit_margin", 2, "avg_margin_pct"),
    )


def segment_margin(gold: DataFrame) -> DataFrame:
    return gold.orderBy(F.desc("avg_profit_margin"), "segment").select(
        "segment", _rounded("avg_profit_margin", 2, "margin_pct")
    )


def trend_with_period(gold: DataFrame) -> DataFrame:
    """Months in order with the first day of each as a date."""
    return gold.orderBy("order_year", "order_month").select(
        "order_year",
        "order_month",
        "order_month_name",
        "total_sales",
        "total_profit",
        "total_orders",
        F.make_date(
            F.col("order_year").cast("int"), F.col("order_month").cast("int"), F.lit(1)
        ).alias("period"),
    )


def year_revenue_trend(gold: DataFrame, year: int) -> DataFrame:
    return (
        gold.filter(F.col("order_year") == year)
        .orderBy("order_month")
        .select("order_month", "order_month_name", "total_sales")
    )


def seasonality(gold: DataFrame) -> DataFrame:
    """Mean monthly sales by calendar month; months without data are listed with NULL.

    ``gold`` has one row per month, so the two sides are at most a calendar wide.
    """
    means = gold.groupBy("order_month").agg(
        round_half_even(exact_sum(F.col("total_sales")) / F.count("total_sales"), 2).alias(
            "mean_sales"
        )
    )
    months = gold.sparkSession.range(1, 13).select(
        F.col("id").alias("order_month"),
        F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.col("id").cast("int")).alias(
            "order_month_name"
        ),
    )
    return months.join(means, "order_month", "left").orderBy("order_month")


def top_products_rounded(gold: DataFrame, limit: int = 10) -> DataFrame:
    return (
        gold.orderBy(F.desc("total_sales"), *PRODUCT_KEYS)
        .limit(limit)
        .select(
            F.col("product_name").alias("product"),
            "category",
            "sub_category",
            _rounded("total_sales", 0),
            _rounded("total_profit", 0),
            "total_units",
        )
    )


def bottom_products(gold: DataFrame, limit: int = 10) -> DataFrame:
    """Products with the smallest profit."""
    return (
        gold.orderBy("total_profit", *PRODUCT_KEYS)
        .limit(limit)
        .select(
            F.col("product_name").alias("product"),
            "sub_category",
            _rounded("total_sales", 0),
            _rounded("total_profit", 0),
            round_half_even(F.col("avg_discount") * 100, 1).alias("avg_discount_pct"),
        )
    )


def loss_products(gold: DataFrame, limit: int = 10) -> DataFrame:
    """The worst products among those with a loss."""
    return (
        gold.filter(F.col("total_profit") < 0)
        .orderBy("total_profit", *PRODUCT_KEYS)
        .limit(limit)
        .select("product_name", "total_profit")
    )


def region_roll_up(fact: DataFrame) -> DataFrame:
    """Sales by region straight from the fact."""
    return (
        fact.groupBy("region")
        .agg(round_half_even(exact_sum(F.col("sales")), 0).alias("total_sales"))
        .orderBy(F.desc("total_sales"), "region")
    )


def discount_margin_sample(
    fact: DataFrame, n: int = 2000, seed: int = 0, key: str | None = "row_id"
) -> DataFrame:
    """Random order lines for looking at discount against margin."""
    return sample_rows(fact, n, seed, key).select(
        "sales", "profit", "discount", "profit_margin_pct", "profit_tier"
    )
