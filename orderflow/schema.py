"""The order-line schema: column names, types and value rules.

Inside the library columns are snake_case; the header spelling of the source files is
only used when reading or writing CSV and when views are registered for ad-hoc SQL.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T


@dataclass(frozen=True)
class ColumnRule:
    """One source column: how it is named, typed and what its values must satisfy."""

    name: str
    header: str
    raw_type: T.DataType
    nullable: bool = False
    allowed: tuple[str, ...] = ()
    min_value: float | None = None
    max_value: float | None = None

    def spark_field(self) -> T.StructField:
        meta = {
            "header": self.header,
            "allowed": list(self.allowed),
            "min": self.min_value,
            "max": self.max_value,
        }
        return T.StructField(self.name, self.raw_type, self.nullable, meta)


_TEXT = T.StringType()
_LONG = T.LongType()
_DOUBLE = T.DoubleType()

# Headers, nullability, allowed values and bounds of the order-line files.
ORDER_LINES: tuple[ColumnRule, ...] = (
    ColumnRule("row_id", "Row ID", _LONG),
    ColumnRule("order_id", "Order ID", _TEXT),
    ColumnRule("order_date", "Order Date", _TEXT),
    ColumnRule("ship_date", "Ship Date", _TEXT),
    ColumnRule(
        "ship_mode",
        "Ship Mode",
        _TEXT,
        allowed=("Second Class", "Standard Class", "First Class", "Same Day"),
    ),
    ColumnRule("customer_id", "Customer ID", _TEXT),
    ColumnRule("customer_name", "Customer Name", _TEXT),
    ColumnRule("segment", "Segment", _TEXT, allowed=("Consumer", "Corporate", "Home Office")),
    ColumnRule("postal_code", "Postal Code", _TEXT, nullable=True),
    ColumnRule("city", "City", _TEXT),
    ColumnRule("state", "State", _TEXT),
    ColumnRule("country", "Country", _TEXT),
    ColumnRule("region", "Region", _TEXT, allowed=("East", "West", "Central", "South")),
    ColumnRule("product_id", "Product ID", _TEXT),
    ColumnRule(
        "category", "Category", _TEXT, allowed=("Furniture", "Office Supplies", "Technology")
    ),
    ColumnRule("sub_category", "Sub-Category", _TEXT),
    ColumnRule("product_name", "Product Name", _TEXT),
    ColumnRule("sales", "Sales", _DOUBLE, min_value=0.0),
    ColumnRule("quantity", "Quantity", _LONG, min_value=1),
    ColumnRule("discount", "Discount", _DOUBLE, min_value=0.0, max_value=1.0),
    ColumnRule("profit", "Profit", _DOUBLE),
)

TITLE_CASED = ("ship_mode", "segment", "region", "category", "sub_category", "country", "state")

DERIVED = (
    "order_year",
    "order_month",
    "order_month_name",
    "order_quarter",
    "order_day_of_week",
    "shipping_days",
    "profit_margin_pct",
    "discount_amount",
    "revenue_per_unit",
    "profit_per_unit",
    "is_profitable",
    "profit_tier",
    "shipping_speed",
)


@dataclass(frozen=True)
class SourceSchema:
    """A set of column rules and the column that identifies a row."""

    rules: tuple[ColumnRule, ...] = field(default=ORDER_LINES)
    key: str = "row_id"

    @property
    def names(self) -> list[str]:
        return [r.name for r in self.rules]

    def struct(self) -> T.StructType:
        return T.StructType([r.spark_field() for r in self.rules])

    def header_of(self, name: str) -> str:
        return {r.name: r.header for r in self.rules}.get(name, name)

    def with_rules(self, **changes: dict) -> SourceSchema:
        """A copy with some rules changed: ``with_rules(region={"allowed": (...)})``."""
        return replace(
            self, rules=tuple(replace(r, **changes.get(r.name, {})) for r in self.rules)
        )

    def without(self, *names: str) -> SourceSchema:
        return replace(self, rules=tuple(r for r in self.rules if r.name not in names))


DEFAULT_SCHEMA = SourceSchema()
