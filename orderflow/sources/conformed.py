"""Order lines out of a normalised star of tables (lines, orders, customers, parts).

Gives the same columns as the CSV reader, so every later step runs on either source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.schema import DEFAULT_SCHEMA

# The star has no profit; a line's cost is taken as this multiple of the list price.
COST_FACTOR = 1.5

# The order-line schema for this source: a text key, no city or state, other value sets.
STAR_SCHEMA = DEFAULT_SCHEMA.without("city", "state").with_rules(
    row_id={"raw_type": T.StringType()},
    ship_mode={"allowed": ("1-Urgent", "2-High", "3-Medium", "4-Not Specified", "5-Low")},
    segment={"allowed": ("Automobile", "Building", "Furniture", "Household", "Machinery")},
    region={"allowed": ("Africa", "America", "Asia", "Europe", "Middle East")},
    category={"allowed": ("Economy", "Large", "Medium", "Promo", "Small", "Standard")},
)


def star_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def conformed_sales(spark: SparkSession, folder: str) -> DataFrame:
    """One typed row per order line.

    No broadcast hints: nation and region fall under the planner's own size limit, while
    customers and parts grow with the data and must be free to shuffle.  Customers are
    joined to orders before the lines, so the widest table is shuffled once per large
    join only, and a hot order or part is split by the adaptive skew join.  Country and region
    come last, so that no shuffle carries their names; nor does one carry times of day, or a
    key that was joined on twice.
    """
    ordered, shipped = F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")
    orders = (
        star_table(spark, folder, "orders")
        .withColumn("o_orderdate", ordered)
        .join(star_table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    )
    lines = (
        star_table(spark, folder, "lineitem")
        .withColumn("l_shipdate", shipped)
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(star_table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(star_table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(star_table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    sales = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
    cost = F.lit(COST_FACTOR) * F.col("p_retailprice") * F.col("l_quantity")
    return lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("o_orderdate").alias("order_date"),
        F.col("l_shipdate").alias("ship_date"),
        F.col("o_orderpriority").alias("ship_mode"),
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("segment"),
        F.concat(F.col("c_custkey").cast("string"), F.lit(".0")).alias("postal_code"),
        F.col("n_name").alias("country"),
        F.col("r_name").alias("region"),
        F.col("l_partkey").alias("product_id"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("sub_category"),
        F.col("p_name").alias("product_name"),
        sales.alias("sales"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        # The files hold negative zeros, which engines print and hash differently.
        F.when(F.col("l_discount") == 0, 0.0).otherwise(F.col("l_discount")).alias("discount"),
        (sales - cost).alias("profit"),
    )


def conformed_raw(spark: SparkSession, folder: str) -> DataFrame:
    """The same lines as the source files spell them: every column is text.

    Dates are written ``M/d/yyyy`` and text columns keep their upper case and get the
    padding that cleaning has to take off.
    """
    df = conformed_sales(spark, folder)
    padded = {c: F.concat(F.lit("  "), F.col(c), F.lit(" ")) for c in ("segment", "region")}
    dates = {c: F.date_format(c, "M/d/yyyy") for c in ("order_date", "ship_date")}
    text = {
        c: F.col(c).cast("string")
        for c in ("order_id", "customer_id", "product_id", "sales", "quantity", "discount", "profit")
    }
    return df.withColumns({**padded, **dates, **text})
