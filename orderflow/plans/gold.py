"""The five aggregate tables.

Every measure is built from additive parts (exact sums and counts), so a table can be
computed from order lines or from any finer roll-up of them with the same result.  The
distinct counts stay exact because a roll-up keeps the counted id in its grain.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.functions import round_half_even
from orderflow.functions.numeric import finite, from_parts, millionths, trillionths, whole_part

# Additive parts of an order line: an exact value in three integers, and how many values.
_SUMMED = {
    "sales": "sales",
    "profit": "profit",
    "discount": "discount",
    "margin": "profit_margin_pct",
}
PARTS = [f"{p}_{kind}" for p in _SUMMED for kind in ("whole", "micros", "picos", "n")] + ["units", "row_n"]


def line_parts(fact: DataFrame, key: str = "row_id") -> DataFrame:
    """The additive parts of each order line next to the grouping columns."""
    parts: dict[str, Column] = {}
    for part, column in _SUMMED.items():
        c = finite(F.col(column))
        parts[f"{part}_whole"] = whole_part(c)
        parts[f"{part}_micros"] = millionths(c)
        parts[f"{part}_picos"] = trillionths(c)
        parts[f"{part}_n"] = c.isNotNull().cast("bigint")
    parts["units"] = F.col("quantity")
    parts["row_n"] = F.col(key).isNotNull().cast("bigint")
    return fact.withColumns(parts)


def roll_up(parts: DataFrame, grain: list[str]) -> DataFrame:
    """Parts added up per ``grain``; partial sums are formed before the shuffle."""
    return parts.groupBy(*grain).agg(*[F.sum(p).alias(p) for p in PARTS])


def _sum(part: str) -> Column:
    return from_parts(*(F.sum(f"{part}_{kind}") for kind in ("whole", "micros", "picos")))


def _total(part: str) -> Column:
    return F.coalesce(_sum(part), F.lit(0.0))


def _mean(part: str) -> Column:
    n = F.sum(f"{part}_n")
    return F.when(n > 0, _sum(part) / n)


# Each measure as a recipe, so that a table builds only the expressions it holds.
_MEASURES: dict[str, Callable[[], Column]] = {
    "total_sales": lambda: round_half_even(_total("sales"), 2),
    "total_profit": lambda: round_half_even(_total("profit"), 2),
    "total_units": lambda: F.coalesce(F.sum("units"), F.lit(0)),
    "total_orders": lambda: F.count_distinct("order_id"),
    "total_customers": lambda: F.count_distinct("customer_id"),
    "total_rows": lambda: F.coalesce(F.sum("row_n"), F.lit(0)),
    "avg_discount": lambda: round_half_even(_mean("discount"), 4),
    "avg_order_value": lambda: round_half_even(_mean("sales"), 2),
    "avg_profit_margin": lambda: round_half_even(_mean("margin"), 2),
}


@dataclass(frozen=True)
class GoldTable:
    """One aggregate table: its keys, its measures in order, and how it is sorted."""

    name: str
    keys: tuple[str, ...]
    measures: tuple[str, ...]
    sort: tuple[str, ...]
    descending: bool = False

    @property
    def columns(self) -> list[str]:
        return [*self.keys, *self.measures]

    @property
    def distinct_ids(self) -> list[str]:
        counted = {"total_orders": "order_id", "total_customers": "customer_id"}
        return [counted[m] for m in self.measures if m in counted]

    @property
    def grain(self) -> list[str]:
        return list(dict.fromkeys([*self.keys, *self.distinct_ids]))

    def from_parts(self, parts: DataFrame) -> DataFrame:
        """The table out of order-line parts or a finer roll-up of them.

        Lines without a value in a key column belong to no group and are left out.
        """
        return (
            parts.dropna(subset=list(self.keys))
            .groupBy(*self.keys)
            .agg(*[_MEASURES[m]().alias(m) for m in self.measures])
            .select(*self.columns)
        )

    def from_sums(self, sums: DataFrame) -> DataFrame:
        """The table out of parts per key with the counts of distinct ids next to them."""
        counts = {"total_orders": "order_id_n", "total_customers": "customer_id_n"}
        measures = {m: lambda c=c: F.coalesce(F.sum(c), F.lit(0)) for m, c in counts.items()}
        return (
            sums.groupBy(*self.keys)
            .agg(*[(measures.get(m) or _MEASURES[m])().alias(m) for m in self.measures])
            .select(*self.columns)
        )

    def ordered(self, df: DataFrame) -> DataFrame:
        """Sorted for reading, ties broken by the keys."""
        lead = [F.desc(c) if self.descending else F.asc(c) for c in self.sort]
        return df.orderBy(*lead, *[F.asc(k) for k in self.keys if k not in self.sort])


_CATEGORY_MEASURES = (
    "total_sales",
    "total_profit",
    "total_units",
    "total_orders",
    "avg_discount",
    "avg_profit_margin",
)

REGION = GoldTable(
    "sales_by_region",
    ("region",),
    (
        "total_sales",
        "total_profit",
        "total_orders",
        "total_rows",
        "avg_discount",
        "avg_profit_margin",
    ),
    sort=("region",),
)
CATEGORY = GoldTable(
    "sales_by_category",
    ("category", "sub_category"),
    _CATEGORY_MEASURES,
    sort=("total_sales",),
    descending=True,
)
SEGMENT = GoldTable(
    "customer_segments",
    ("segment",),
    (
        "total_customers",
        "total_orders",
        "total_sales",
        "total_profit",
        "avg_order_value",
        "avg_profit_margin",
    ),
    sort=("segment",),
)
MONTH = GoldTable(
    "monthly_trends",
    ("order_year", "order_month", "order_month_name"),
    ("total_sales", "total_profit", "total_orders", "total_units"),
    sort=("order_year", "order_month"),
)
PRODUCT = GoldTable(
    "product_performance",
    ("product_id", "product_name", "category", "sub_category"),
    _CATEGORY_MEASURES,
    sort=("total_sales",),
    descending=True,
)

GOLD = (REGION, CATEGORY, SEGMENT, MONTH, PRODUCT)

# Tables of what describes an order.  They share one roll-up to about a row per order; the
# product tables do not, as an order seldom holds a product twice and nothing would shrink.
ORDER_TABLES = (REGION, SEGMENT, MONTH)
PRODUCT_TABLES = (CATEGORY, PRODUCT)


def build(table: GoldTable, fact: DataFrame, key: str = "row_id") -> DataFrame:
    """One aggregate table from the enriched fact, sorted.

    With one counted id Spark itself aggregates by (keys, id) first, which spreads a group
    with a third of all lines over its ids.  With two, it would expand every line once per
    id, so the lines are rolled up to keys and ids before.
    """
    parts = line_parts(fact, key)
    if len(table.distinct_ids) > 1:
        parts = roll_up(parts, table.grain)
    return table.ordered(table.from_parts(parts))


def sales_by_region(fact: DataFrame) -> DataFrame:
    return build(REGION, fact)


def sales_by_category(fact: DataFrame) -> DataFrame:
    return build(CATEGORY, fact)


def customer_segments(fact: DataFrame) -> DataFrame:
    return build(SEGMENT, fact)


def monthly_trends(fact: DataFrame) -> DataFrame:
    return build(MONTH, fact)


def product_performance(fact: DataFrame) -> DataFrame:
    return build(PRODUCT, fact)


def order_roll_up(fact: DataFrame, key: str = "row_id") -> DataFrame:
    """The roll-up behind the order tables; write it once and build all three from it."""
    grain = dict.fromkeys(c for t in ORDER_TABLES for c in t.grain)
    return roll_up(line_parts(fact, key), list(grain))


def all_tables(
    fact: DataFrame, rolled: DataFrame | None = None, key: str = "row_id"
) -> dict[str, DataFrame]:
    """All five tables by name, unsorted; ``rolled`` is a materialised ``order_roll_up``.

    Stored tables have no order to keep, so sorting is left to the reports that read them.
    """
    if rolled is None:
        rolled = order_roll_up(fact, key)
    parts = line_parts(fact, key)
    source = {t: rolled for t in ORDER_TABLES} | {t: parts for t in PRODUCT_TABLES}
    return {t.name: t.from_parts(source[t]) for t in GOLD}
