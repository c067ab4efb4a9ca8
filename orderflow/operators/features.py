"""Derived columns: calendar, money and bucket features.  No shuffle, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.functions import guarded_ratio, round_half_even


def add_time_features(df: DataFrame) -> DataFrame:
    day, ship = F.col("order_date"), F.col("ship_date")
    return df.withColumns(
        {
            "order_year": F.year(day).cast("bigint"),
            "order_month": F.month(day).cast("bigint"),
            "order_month_name": F.date_format(day, "MMM"),
            "order_quarter": F.quarter(day).cast("bigint"),
            "order_day_of_week": F.weekday(day).cast("bigint"),  # Monday is 0
            "shipping_days": F.datediff(ship, day).cast("bigint"),
        }
    )


def margin_pct(sales: Column, profit: Column) -> Column:
    """Profit as a percentage of sales, two decimals."""
    return round_half_even(guarded_ratio(profit, sales) * 100, 2)


def add_financial_features(df: DataFrame) -> DataFrame:
    sales, profit, units = F.col("sales"), F.col("profit"), F.col("quantity")
    return df.withColumns(
        {
            "profit_margin_pct": margin_pct(sales, profit),
            "discount_amount": round_half_even(sales * F.col("discount"), 2),
            "revenue_per_unit": round_half_even(guarded_ratio(sales, units), 2),
            "profit_per_unit": round_half_even(guarded_ratio(profit, units), 2),
            "is_profitable": F.coalesce(profit > 0, F.lit(False)),
        }
    )


def profit_tier(margin: Column) -> Column:
    """Tier of an already rounded margin; the first matching bound wins."""
    return (
        F.when(margin < 0, "Loss")
        .when(margin < 10, "Low")
        .when(margin < 20, "Medium")
        .when(margin >= 20, "High")
        .otherwise("Unknown")
    )


def shipping_speed(days: Column) -> Column:
    """Speed label; negative day counts fall into the first bucket."""
    return (
        F.when(days <= 1, "Same Day")
        .when(days <= 3, "Express")
        .when(days <= 6, "Standard")
        .when(days >= 7, "Slow")
        .otherwise("Unknown")
    )


def add_categorical_features(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "profit_tier": profit_tier(F.col("profit_margin_pct")),
            "shipping_speed": shipping_speed(F.col("shipping_days")),
        }
    )


def engineer(df: DataFrame) -> DataFrame:
    """All thirteen derived columns; the row count is unchanged."""
    return (
        df.transform(add_time_features)
        .transform(add_financial_features)
        .transform(add_categorical_features)
    )
