"""Every operator and report as a query over the star tables: (spark, folder) -> DataFrame."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderflow.functions import exact_mean, exact_sum, round_half_even
from orderflow.operators import clean, dedup, drift, features, incremental, profile, quality, rows
from orderflow.plans import gold, maintained, run, serve
from orderflow.session import Stage
from orderflow.sources import bronze, export, names
from orderflow.sources.conformed import STAR_SCHEMA, conformed_raw, conformed_sales, star_table
from orderflow.sources.lake import FACT, Lake

# Dates the incremental queries cut at, and the served year; all lie inside the data.
FACT_END = "2001-06-15"
WATERMARK = "2001-06-01"
LEDGER_CUT = "1998-01-01"
DRIFT_CUT = "2001-01-01"
YEAR = 2000
YEARS = (1995, 2001)
BINS = 10
EXTRA_COST = 0.28
# Text lines shrink to a quarter; a compressed file is one task's, so it stays at some 40 MB of text.
PACKED = {"compression": "gzip", "rows_per_file": 200_000}

# Value rules with one region left out and a low quantity bound, so that checks fail.
STRICT_SCHEMA = STAR_SCHEMA.with_rules(
    ship_mode={"allowed": ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")},
    segment={"allowed": ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")},
    region={"allowed": ("AMERICA", "ASIA", "EUROPE")},
    category={"allowed": ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")},
    quantity={"max_value": 45},
)



# Nothing in the tables breaks these.
DEFAULT_RANGES = STAR_SCHEMA.with_rules(**{c: {"allowed": None} for c in ("ship_mode", "segment", "region", "category")})
LENIENT = run.Config(schema=STAR_SCHEMA, fail_on_quality_error=False, make_profile=False)


def fact(spark: SparkSession, folder: str) -> DataFrame:
    return features.engineer(conformed_sales(spark, folder))


def dear_fact(spark: SparkSession, folder: str) -> DataFrame:
    """The fact with so much higher costs that some sub-categories lose and some do not."""
    sales = conformed_sales(spark, folder)
    return features.engineer(sales.withColumn("profit", F.col("profit") - F.lit(EXTRA_COST) * F.col("sales")))


def _gold(table: gold.GoldTable, report=None, *args, source=fact, **kwargs):
    """A query for an aggregate table, or for a report over it."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        df = gold.build(table, source(spark, folder))
        return report(df, *args, **kwargs) if report else df

    return query


# --- cleaning ----------------------------------------------------------------------------


def clean_strip_title(spark, folder):
    raw = conformed_raw(spark, folder)
    df = clean.normalise_categoricals(clean.strip_whitespace(raw))
    return df.select("row_id", "ship_mode", "segment", "region", "category", "sub_category", "country")


def clean_postal_code(spark, folder):
    return clean.fix_postal_codes(conformed_raw(spark, folder)).select("row_id", "postal_code")


def date_parse_roundtrip(spark, folder):
    parsed = clean.parse_dates(conformed_raw(spark, folder))
    iso = {c: F.date_format(c, "yyyy-MM-dd") for c in ("order_date", "ship_date")}
    return parsed.withColumns(iso).select("row_id", *iso)


def coerce_numerics(spark, folder):
    """Numbers, words and the text NaN as they can come from a file, all as text."""
    orders = star_table(spark, folder, "orders")
    price = F.col("o_totalprice").cast("string")
    text = orders.select(
        "o_orderkey",
        price.alias("sales"),
        F.col("o_orderpriority").alias("discount"),
        F.when(F.col("o_orderstatus") == "P", "nan").otherwise(price).alias("profit"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.col("o_custkey").cast("string"), F.lit(".0")))
        .when(F.col("o_orderstatus") == "P", F.concat(F.lit("1,"), F.col("o_custkey").cast("string")))
        .otherwise(F.col("o_custkey").cast("string"))
        .alias("quantity"),
    )
    return clean.cast_numerics(text)


def clean_rows(spark, folder):
    """The whole cleaning of raw text lines, urgent ones of which come twice."""
    raw = conformed_raw(spark, folder)
    twice = raw.unionByName(raw.filter(F.col("ship_mode") == "1-URGENT"))
    return clean.clean(twice, schema=STAR_SCHEMA, stage=Stage(spark))


def _repeated_lines(spark, folder):
    """Order lines with every returned line twice."""
    lines = star_table(spark, folder, "lineitem").withColumn(
        "l_discount", F.when(F.col("l_discount") == 0, 0.0).otherwise(F.col("l_discount"))
    )
    return lines.unionByName(lines.filter(F.col("l_returnflag") == "R"))


def dedup_full_rows(spark, folder):
    return dedup.drop_full_duplicates(_repeated_lines(spark, folder))


def duplicate_count(spark, folder):
    return dedup.duplicate_count(_repeated_lines(spark, folder))


# --- features ----------------------------------------------------------------------------


def time_features(spark, folder):
    df = features.add_time_features(conformed_sales(spark, folder))
    return df.select(
        "row_id",
        "order_year",
        "order_month",
        "order_month_name",
        "order_quarter",
        "order_day_of_week",
        "shipping_days",
    )


def financial_features(spark, folder):
    df = features.add_financial_features(conformed_sales(spark, folder))
    return df.select(
        "row_id",
        "profit_margin_pct",
        "discount_amount",
        "revenue_per_unit",
        "profit_per_unit",
        "is_profitable",
    )


def categorical_features(spark, folder):
    return fact(spark, folder).select("row_id", "profit_tier", "shipping_speed")


def guarded_features(spark, folder):
    """Derived columns of lines without sales, quantity, profit or ship date."""
    sales = conformed_sales(spark, folder)
    mode = F.col("ship_mode")
    holed = sales.withColumns(
        {
            "sales": F.when(mode == "1-URGENT", 0.0).otherwise(F.col("sales")),
            "quantity": F.when(mode == "2-HIGH", 0).when(mode != "3-MEDIUM", F.col("quantity")).cast("bigint"),
            "profit": F.when(mode != "5-LOW", F.col("profit")),
            "ship_date": F.when(mode != "4-NOT SPECIFIED", F.col("ship_date")),
        }
    )
    return features.engineer(holed).select(
        "row_id", "profit_margin_pct", "discount_amount", "revenue_per_unit", "profit_per_unit",
        "is_profitable", "profit_tier", "shipping_days", "shipping_speed",
    )


def tiny_sums(spark, folder):
    """Sums and means of values far below a millionth."""
    tiny = F.col("discount") * F.lit(4e-7)
    sales = conformed_sales(spark, folder).withColumn("tiny", tiny)
    scaled = {"total": exact_sum(F.col("tiny")), "mean": exact_mean(F.col("tiny"))}
    return sales.groupBy("region").agg(*[round_half_even(c * 1e6, 3).alias(n) for n, c in scaled.items()])


def tier_counts(spark, folder):
    return fact(spark, folder).groupBy("profit_tier").agg(F.count(F.lit(1)).alias("rows"))


def shipping_speed_counts(spark, folder):
    return fact(spark, folder).groupBy("shipping_speed").agg(F.count(F.lit(1)).alias("rows"))


# --- incremental -------------------------------------------------------------------------


def watermark_filter(spark, folder):
    df = bronze.since_watermark(conformed_sales(spark, folder), WATERMARK, 3)
    return df.select("row_id", "order_date")


def watermark_candidate(spark, folder):
    return incremental.watermark_candidate(conformed_sales(spark, folder))


def _fact_and_batch(spark, folder):
    """The fact up to a date, and a later batch that overlaps it."""
    sales = fact(spark, folder)
    return sales.filter(F.col("order_date") < FACT_END), bronze.since_watermark(sales, WATERMARK, 3)


def anti_join_new_rows(spark, folder):
    old, batch = _fact_and_batch(spark, folder)
    return incremental.new_rows(batch, old).select("row_id", "order_id", "order_date", "sales")


def incremental_fact(spark, folder):
    old, batch = _fact_and_batch(spark, folder)
    return incremental.incremental_fact(old, batch).select("row_id", "order_date", "sales", "profit_tier")


def _after_increment(table: gold.GoldTable):
    """An aggregate table from the state of a fact, and a later batch merged into it."""

    def query(spark, folder):
        stage = Stage(spark)
        old, batch = _fact_and_batch(spark, folder)
        new = stage.put("new", incremental.new_rows(batch, old))
        before, after = gold.line_parts(old), gold.line_parts(new)
        if len(table.distinct_ids) > 1:
            before = stage.put("rolled", gold.roll_up(before, table.grain))
        pairs = {c: stage.put(f"pairs_{c}", maintained.distinct_pairs(table, before, c)) for c in table.distinct_ids}
        sums = stage.put("sums", maintained.counted(table, None, before, pairs))
        fresh = {c: maintained.unseen(maintained.distinct_pairs(table, after, c), pairs[c]) for c in pairs}
        return table.ordered(table.from_sums(maintained.counted(table, sums, after, fresh)))

    return query


def maintained_tables(spark, folder):
    """The region and month tables of a lake after three loads, the last a repeat of the second."""
    lake, stage = Lake(spark, Stage(spark).path("lake")), Stage(spark)
    # As in a run, what is loaded is staged once and not joined again for every step.
    old, batch = (stage.put(n, df) for n, df in zip(("old", "batch"), _fact_and_batch(spark, folder)))
    run.load_fact(lake, old, "row_id", derive=features.engineer)
    maintained.renew(lake, stage)
    for name in ("second", "third"):
        run.load_fact(lake, batch, "row_id", derive=features.engineer)
        maintained.renew(lake, Stage(spark, f"{stage.root}/{name}"))
    region, month = lake.read(gold.REGION.name), lake.read(gold.MONTH.name)
    shared = ["total_sales", "total_profit", "total_orders"]
    return region.select("region", *shared).unionByName(month.select(F.col("order_month_name").alias("region"), *shared))


def _loaded(spark, folder, config: run.Config) -> Lake:
    """A lake after a run over the lines as CSV."""
    lake = Lake(spark, Stage(spark).path("lake"))
    run.run(spark, _as_csv(spark, folder), lake.root, config)
    return lake


def recovered_fact(spark, folder):
    """A mark is there and the fact is not, as after a lost table: the run loads everything."""
    lake = Lake(spark, Stage(spark).path("lake"))
    run.write_watermark(lake, date.fromisoformat(WATERMARK), "lost")
    run.run(spark, _as_csv(spark, folder), lake.root, LENIENT)
    return lake.read(FACT).select("row_id", "order_date", "quantity", "sales")


def second_run_fact(spark, folder):
    """The fact after a first load, a batch that overlaps it, and the same batch again."""
    lake = Lake(spark, Stage(spark).path("lake"))
    path = _as_csv(spark, folder, FACT_END)
    run.run(spark, path, lake.root, LENIENT)
    later = bronze.since_watermark(conformed_raw(spark, folder), WATERMARK, 0, "M/d/yyyy")
    bronze.write_csv(later, path, STAR_SCHEMA, **PACKED)
    for _ in range(2):
        run.run(spark, path, lake.root, LENIENT)
    return lake.read(FACT).select("row_id", "order_date", "quantity", "sales")


def run_reports(spark, folder):
    """What four runs report: a first load, a repeat, a full refresh, and one the gate stops."""
    lake = Lake(spark, Stage(spark).path("lake"))
    path = _as_csv(spark, folder)
    for full in (False, False, True):
        run.run(spark, path, lake.root, LENIENT, full_refresh=full)
    strict = replace(LENIENT, schema=STAR_SCHEMA.with_rules(quantity={"max_value": 45}), fail_on_quality_error=True)
    try:
        run.run(spark, path, lake.root, strict, full_refresh=True)
    except quality.QualityGateError:
        pass
    text = F.col("report")
    number = lambda p: F.get_json_object(text, p).cast("bigint")
    return lake.read("runs").select(
        F.row_number().over(Window.orderBy("run_timestamp")).cast("bigint").alias("run"),
        "overall_status",
        number("$.stages.extract.row_count").alias("extracted"),
        number("$.stages.clean.rows_output").alias("cleaned"),
        number("$.stages.load.new_rows_inserted").alias("inserted"),
        number("$.stages.load.rows_loaded").alias("loaded"),
        F.get_json_object(text, "$.seconds.extract").isNotNull().alias("extract_timed"),
        F.get_json_object(text, "$.stages.profile").isNotNull().alias("profiled"),
    )


def append_by_name(spark, folder):
    """Later orders, columns in another order and one of them missing, behind the earlier ones."""
    orders = star_table(spark, folder, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))
    old = orders.filter(F.col("o_orderdate") < WATERMARK)
    new = orders.filter(F.col("o_orderdate") >= WATERMARK).select(
        "o_orderpriority", "o_orderdate", "o_orderkey", "o_custkey", "o_orderstatus"
    )
    return incremental.append_by_name(old, new)


def watermark_state(spark, folder):
    """The state after two loads, the second of which saw only older orders."""
    orders = star_table(spark, folder, "orders")
    lake = Lake(spark, Stage(spark).root)
    for end in ("2100-01-01", WATERMARK):
        seen = orders.filter(F.col("o_orderdate") < end)
        newest = seen.agg(F.max("o_orderdate").cast("date").alias("d")).first()["d"]
        run.write_watermark(lake, incremental.later(run.read_watermark(lake), newest), end)
    return lake.read("state").agg(
        F.max_by("last_watermark", "updated_at").alias("last_watermark"),
        F.max_by("last_run_id", "updated_at").alias("last_run_id"),
    )


# --- quality and monitoring --------------------------------------------------------------


def _doubtful_sales(spark, folder):
    sales = conformed_sales(spark, folder)
    return sales.unionByName(sales.filter(F.col("ship_mode") == "1-URGENT"))


def quality_report(spark, folder):
    return quality.quality_report(_doubtful_sales(spark, folder), STRICT_SCHEMA, date_checks=True)


def quality_summary(spark, folder):
    return quality.summarise(quality_report(spark, folder))


def _holed_sales(spark, folder):
    """Lines with missing values in columns that need one, and without a declared column."""
    sales = conformed_sales(spark, folder)
    urgent, high = F.col("ship_mode") == "1-URGENT", F.col("ship_mode") == "2-HIGH"
    return sales.withColumns(
        {
            "order_id": F.when(~urgent, F.col("order_id")),
            "sales": F.when(urgent, float("nan")).when(high, float("inf")).otherwise(F.col("sales")),
        }
    ).drop("country")


def quality_holes(spark, folder):
    return quality.quality_report(_holed_sales(spark, folder), STRICT_SCHEMA, date_checks=True)


def gate_outcome(spark, folder):
    """What the gate returns for two reports, and whether it stops where it has to."""
    rows = []
    for name, df, schema in (
        ("holes", _holed_sales(spark, folder), STRICT_SCHEMA),
        ("clean", conformed_sales(spark, folder), DEFAULT_RANGES),
    ):
        report = Stage(spark).put("report", quality.quality_report(df, schema))
        outcome = quality.gate(report, name, fail_on_error=False)
        try:
            quality.gate(report, name)
            stopped = False
        except quality.QualityGateError:
            stopped = True
        rows.append((name, outcome["passed"], outcome["total_checks"], outcome["failed_checks"], stopped))
    return spark.createDataFrame(rows, "stage string, passed boolean, total long, failed long, stopped boolean")


def raised_conditions(spark, folder):
    """Conditions that must raise, each on files or frames of the tables."""
    sales, path = conformed_raw(spark, folder), _as_csv(spark, folder)
    short = Stage(spark).path("short")
    short_lines = sales.select("row_id", "sales").write.option("header", True)
    short_lines.option("compression", PACKED["compression"]).csv(short)
    trends, products = (gold.build(t, fact(spark, folder)) for t in (gold.MONTH, gold.PRODUCT))
    attempts = {
        "missing file": lambda: bronze.read_bronze(spark, path + "-none", STAR_SCHEMA),
        "missing columns": lambda: bronze.read_bronze(spark, short, STAR_SCHEMA),
        "year out of bounds": lambda: serve.monthly(trends, YEAR, (2014, 2017)),
        "limit out of bounds": lambda: serve.top_products(products, 0),
        "table not loaded": lambda: Lake(spark, Stage(spark).root).read(FACT),
        "whole file": lambda: bronze.read_bronze(spark, path, STAR_SCHEMA),
    }
    rows = []
    for name, attempt in attempts.items():
        try:
            attempt()
            rows.append((name, "none"))
        except (LookupError, ValueError, FileNotFoundError) as err:
            rows.append((name, type(err).__name__))
    return spark.createDataFrame(rows, "condition string, raised string")


def unexpected_brands(spark, folder):
    """More unexpected values than anybody would list."""
    schema = STAR_SCHEMA.with_rules(sub_category={"allowed": ("Brand#1", "Brand#2")}, category={"allowed": None})
    rules = [r for r in schema.rules if r.name == "sub_category"]
    return quality.rogue_values(conformed_sales(spark, folder), rules).drop("position")


def rogue_values(spark, folder):
    found = quality.rogue_values(conformed_sales(spark, folder), list(STRICT_SCHEMA.rules))
    return found.drop("position")


def drift_stats(spark, folder):
    return drift.drift_stats(fact(spark, folder))


def drift_findings(spark, folder):
    sales = fact(spark, folder)
    before = sales.filter(F.col("order_date") < DRIFT_CUT)
    return drift.drift_findings(drift.drift_stats(sales), drift.drift_stats(before))


def drift_between_runs(spark, folder):
    """What two loads stored of their statistics, compared: the second one read its batch alone."""
    lake, sales = Lake(spark, Stage(spark).path("lake")), Stage(spark).put("sales", fact(spark, folder))
    cut = F.col("order_date") < DRIFT_CUT
    for name, batch in (("first", sales.filter(cut)), ("second", sales.filter(~cut))):
        run.load(lake, batch, LENIENT, Stage(spark), derive=features.engineer)
        run.compare(lake, lake.read(FACT), LENIENT, name)
    stats = lake.read("stats")
    of = {name: stats.filter(F.col("run_id") == name) for name in ("first", "second")}
    return drift.drift_findings(of["second"], of["first"])


def row_minimum(spark, folder):
    """Whether the reports of two runs say that too few rows came."""
    lake, path = Lake(spark, Stage(spark).path("lake")), _as_csv(spark, folder, LEDGER_CUT)
    for least in (1, 10**9):
        run.run(spark, path, lake.root, replace(LENIENT, min_rows=least), full_refresh=True)
    text = F.col("report")
    return lake.read("runs").select(
        F.row_number().over(Window.orderBy("run_timestamp")).cast("bigint").alias("run"),
        F.get_json_object(text, "$.stages.clean.rows_output").cast("bigint").alias("rows_output"),
        F.get_json_object(text, "$.stages.clean.below_min_rows").cast("boolean").alias("below_min_rows"),
    )


def profile_columns(spark, folder):
    return profile.profile_columns(fact(spark, folder), Stage(spark))


def profile_histogram(spark, folder):
    return profile.profile_histogram(fact(spark, folder), BINS)


def profile_correlation(spark, folder):
    return profile.profile_correlation(fact(spark, folder))


def profile_missing(spark, folder):
    return profile.profile_missing(coerce_numerics(spark, folder))


# --- reports that are not over one aggregate table ---------------------------------------


def region_rollup_fact(spark, folder):
    return serve.region_roll_up(fact(spark, folder))


def sample_fact(spark, folder):
    return serve.discount_margin_sample(fact(spark, folder))


def adhoc_sql(spark, folder):
    """Free SQL over the registered views of a loaded lake."""
    lake = Lake(spark, Stage(spark).root)
    sales = fact(spark, folder)
    lake.write_fact(sales, "overwrite", features.engineer)
    run.rebuild_gold(lake, lake.read(FACT), "row_id", Stage(spark))
    lake.register_views(header_names=True)
    return spark.sql(
        """
        SELECT f.Region AS region, f.profit_tier, count(*) AS line_count,
               max(g.total_orders) AS region_orders
        FROM fact_sales f JOIN agg_sales_by_region g ON f.Region = g.Region
        GROUP BY f.Region, f.profit_tier
        """
    )


# --- sources, export, run ----------------------------------------------------------------


def _as_csv(spark, folder, before: str | None = None) -> str:
    """The lines as CSV, up to a day if given."""
    path, raw = Stage(spark).path("csv"), conformed_raw(spark, folder)
    if before:
        raw = raw.filter(F.to_date("order_date", "M/d/yyyy") < before)
    bronze.write_csv(raw, path, STAR_SCHEMA, **PACKED)
    return path


def mixed_header_csv(spark, folder):
    """A folder of files with other column orders, one of them with a column more."""
    raw, path = conformed_raw(spark, folder), Stage(spark).path("csv")
    early = F.to_date("order_date", "M/d/yyyy") < WATERMARK
    bronze.write_csv(raw.filter(early), path, STAR_SCHEMA)
    turned = raw.filter(~early).select(*[F.col(r.name).alias(r.header) for r in reversed(STAR_SCHEMA.rules)])
    noted = turned.withColumn("Note", F.col("Row ID"))
    noted.write.mode("append").option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
    df = bronze.read_bronze(spark, path, STAR_SCHEMA)
    return df.select("row_id", "order_date", "region", "product_name", "sales", "quantity", "Note")


def csv_extract(spark, folder):
    """Lines written to CSV under header names and read back through all gates."""
    batch = bronze.extract(spark, _as_csv(spark, folder), WATERMARK, 3, STAR_SCHEMA)
    return batch.frame


def ledger_extract(spark, folder):
    """Three deliveries, all of them read once; then only files that can hold what is new.

    The last delivery overlaps the one before.  Every row tells how many rows the source held
    and whether files were left closed.
    """
    stage, raw = Stage(spark), conformed_raw(spark, folder)
    lake, path, day = Lake(spark, stage.path("lake")), stage.path("csv"), F.to_date("order_date", "M/d/yyyy")
    for wanted in (day < LEDGER_CUT, (day >= LEDGER_CUT) & (day < FACT_END), day >= WATERMARK):
        bronze.write_csv(raw.filter(wanted), path, STAR_SCHEMA, **PACKED)
    for name, since in (("first", None), ("again", WATERMARK)):
        batch, read = bronze.extract_unread(Stage(spark), path, lake.find("files"), since, 3, STAR_SCHEMA, run_id=name)
        lake.append("files", read)
    counts = batch.metadata()
    return batch.frame.select(
        "row_id",
        "order_date",
        "sales",
        F.lit(counts["rows_before_filter"]).cast("long").alias("source_rows"),
        F.lit(counts["row_count"]).cast("long").alias("batch_rows"),
        F.lit(counts["files_skipped"] > 0).alias("files_left_closed"),
    )


def extract_counts(spark, folder):
    """The counts observed while the batch of csv_extract is written."""
    batch = bronze.extract(spark, _as_csv(spark, folder), WATERMARK, 3, STAR_SCHEMA)
    Stage(spark).put("raw", batch.frame)
    meta = batch.metadata()
    counts = ("rows_before_filter", "row_count", "column_count")
    return spark.range(1).select(*[F.lit(meta[c]).cast("bigint").alias(c) for c in counts])


def _exported(spark, folder) -> tuple[dict[str, DataFrame], str]:
    """Stored tables and the folder they were exported to."""
    stage = Stage(spark)
    lake = Lake(spark, stage.path("lake"))
    lake.write_fact(fact(spark, folder), "overwrite", features.engineer)
    run.rebuild_gold(lake, lake.read(FACT), "row_id", stage)
    frames, target = export.stored_tables(lake), stage.path("export")
    export.export_tables(frames, target)
    return frames, target


def export_parity(spark, folder):
    frames, target = _exported(spark, folder)
    return export.row_count_parity(spark, frames, target)


def export_layout(spark, folder):
    """Rows and sales per month folder of the exported fact, read back from the export."""
    _, target = _exported(spark, folder)
    written = spark.read.parquet(f"{target}/{export.export_name(FACT)}")
    return written.groupBy(F.col("order_month_start").cast("date").alias("month_start")).agg(
        F.count(F.lit(1)).alias("rows"),
        round_half_even(exact_sum(F.col("sales")), 2).alias("total_sales"),
    )


def sanitised_names(spark, folder):
    """The category table under file headers, renamed for a warehouse."""
    df = gold.build(gold.CATEGORY, fact(spark, folder))
    headed = df.toDF(*[STAR_SCHEMA.header_of(c).replace("total_", " 1st Total: ") for c in df.columns])
    return names.sanitize_columns(headed)


def next_row_ids(spark, folder):
    """All lines numbered on from the largest order key, in the order of their key text."""
    lines = conformed_sales(spark, folder).select(F.col("row_id").alias("line"), "order_id")
    first = rows.next_row_id(star_table(spark, folder, "orders"), "o_orderkey")
    return rows.assign_row_ids(lines, first, Stage(spark), order_by=["line"])


def end_to_end_regions(spark, folder):
    """CSV to aggregate tables through the whole run; its region table."""
    return _loaded(spark, folder, LENIENT).read(gold.REGION.name)


QUERIES = {
    "sales_by_region": _gold(gold.REGION),
    "sales_by_category": _gold(gold.CATEGORY),
    "customer_segments": _gold(gold.SEGMENT),
    "monthly_trends": _gold(gold.MONTH),
    "product_performance": _gold(gold.PRODUCT),
    "regions": _gold(gold.REGION, serve.regions),
    "trends_all_years": _gold(gold.MONTH, serve.monthly),
    "trends_for_year": _gold(gold.MONTH, serve.monthly, YEAR, YEARS),
    "top_products": _gold(gold.PRODUCT, serve.top_products, 25),
    "segments": _gold(gold.SEGMENT, serve.segments),
    "regional_performance": _gold(gold.REGION, serve.regional_performance),
    "regions_by_profit": _gold(gold.REGION, serve.regions_by_profit),
    "top_subcategories": _gold(gold.CATEGORY, serve.top_sub_categories),
    "loss_subcategories": _gold(gold.CATEGORY, serve.loss_sub_categories, source=dear_fact),
    "most_profitable_subcategories": _gold(gold.CATEGORY, serve.most_profitable_sub_categories),
    "segment_kpis": _gold(gold.SEGMENT, serve.segment_kpis),
    "segment_margin": _gold(gold.SEGMENT, serve.segment_margin),
    "trend_with_period": _gold(gold.MONTH, serve.trend_with_period),
    "year_revenue_trend": _gold(gold.MONTH, serve.year_revenue_trend, YEAR),
    "seasonality": _gold(gold.MONTH, serve.seasonality),
    "top_products_rounded": _gold(gold.PRODUCT, serve.top_products_rounded),
    "bottom_products": _gold(gold.PRODUCT, serve.bottom_products),
    "loss_products": _gold(gold.PRODUCT, serve.loss_products),
    "region_rollup_fact": region_rollup_fact,
    "sample_fact": sample_fact,
    "adhoc_sql": adhoc_sql,
    "clean_strip_title": clean_strip_title,
    "clean_postal_code": clean_postal_code,
    "date_parse_roundtrip": date_parse_roundtrip,
    "coerce_numerics": coerce_numerics,
    "clean_rows": clean_rows,
    "dedup_full_rows": dedup_full_rows,
    "duplicate_count": duplicate_count,
    "time_features": time_features,
    "financial_features": financial_features,
    "categorical_features": categorical_features,
    "engineered_fact": fact,
    "tier_counts": tier_counts,
    "shipping_speed_counts": shipping_speed_counts,
    "watermark_filter": watermark_filter,
    "watermark_candidate": watermark_candidate,
    "watermark_state": watermark_state,
    "anti_join_new_rows": anti_join_new_rows,
    "incremental_fact": incremental_fact,
    "gold_after_increment": _after_increment(gold.MONTH),
    **{f"{t.name}_after_increment": _after_increment(t) for t in gold.GOLD if t is not gold.MONTH},
    "maintained_tables": maintained_tables,
    "recovered_fact": recovered_fact,
    "second_run_fact": second_run_fact,
    "run_reports": run_reports,
    "guarded_features": guarded_features,
    "tiny_sums": tiny_sums,
    "quality_holes": quality_holes,
    "gate_outcome": gate_outcome,
    "raised_conditions": raised_conditions,
    "unexpected_brands": unexpected_brands,
    "mixed_header_csv": mixed_header_csv,
    "append_by_name": append_by_name,
    "quality_report": quality_report,
    "quality_summary": quality_summary,
    "rogue_values": rogue_values,
    "drift_stats": drift_stats,
    "drift_findings": drift_findings,
    "drift_between_runs": drift_between_runs,
    "row_minimum": row_minimum,
    "profile_columns": profile_columns,
    "profile_histogram": profile_histogram,
    "profile_correlation": profile_correlation,
    "profile_missing": profile_missing,
    "csv_extract": csv_extract,
    "ledger_extract": ledger_extract,
    "extract_counts": extract_counts,
    "export_parity": export_parity,
    "export_layout": export_layout,
    "sanitised_names": sanitised_names,
    "next_row_ids": next_row_ids,
    "end_to_end_regions": end_to_end_regions,
}
