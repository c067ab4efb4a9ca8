"""Run-over-run drift: a snapshot of statistics in long form, and its comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.functions import round_half_even
from orderflow.functions.numeric import from_parts, summands

MEASURES = ("sales", "profit", "discount")
DISTINCT = {
    "unique_customers": "customer_id",
    "unique_products": "product_id",
    "unique_regions": "region",
}
DATES = ("order_date_min", "order_date_max")


def drift_stats(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(metric, value, text): one row per statistic of the frame.

    Numbers are in ``value``, the date bounds in ``text``.  Columns the frame lacks are
    left out.  NaN and infinities count as missing.  Exact distinct counts are spread over the
    counted ids; ``approximate`` replaces them by sketches where the id columns are huge.
    """
    columns = set(df.columns)
    measures = [m for m in MEASURES if m in columns]
    # Finite values and their additive parts are projected once and then only added up.
    parts: dict[str, Column] = {}
    for name in measures:
        parts |= {f"{name}_{kind}": c for kind, c in summands(F.col(name)).items()}
    dated = "order_date" in columns and df.schema["order_date"].dataType.typeName() == "date"
    lines = df.select(*[c.alias(n) for n, c in parts.items()], *["order_date"] * dated)

    rows = F.count(F.lit(1))
    stats = {"row_count": rows, "column_count": F.lit(len(df.columns))}
    for name in measures:
        value = F.col(f"{name}_value")
        n = F.count(value)
        mean = from_parts(*(F.sum(f"{name}_{kind}") for kind in ("whole", "micros", "picos"))) / n
        stats[f"{name}_mean"] = round_half_even(F.when(n > 0, mean), 4)
        stats[f"{name}_std"] = round_half_even(F.stddev_samp(value), 4)
        # Zero rows have no null rate, as they have no mean.
        stats[f"{name}_null_rate"] = round_half_even(F.when(rows > 0, (rows - n) / rows), 6)
    values = {m: c.cast("double") for m, c in stats.items()}
    texts = {}
    if dated:
        texts = {f"order_date_{s}": F.date_format(f("order_date"), "yyyy-MM-dd") for s, f in (("min", F.min), ("max", F.max))}
    wide = lines.agg(*[c.alias(m) for m, c in {**values, **texts}.items()])
    found = wide.select(F.inline(F.array(*[_row(m, F.col(m) if m in values else None, F.col(m) if m in texts else None) for m in [*values, *texts]])))
    # Each distinct count reads its own column alone; several in one pass would copy every line.
    for metric, name in ((m, n) for m, n in DISTINCT.items() if n in columns):
        ids = df.select(F.col(name).alias("id"))
        counted = ids.agg(F.approx_count_distinct("id").alias("n")) if approximate else ids.distinct().agg(F.count("id").alias("n"))
        found = found.unionByName(counted.select(F.inline(F.array(_row(metric, F.col("n").cast("double"), None)))))
    return found


def stat_parts(df: DataFrame) -> DataFrame:
    """One row of what the statistics of a frame are merged from: counts, exact sums, spreads, days."""
    measures = [m for m in MEASURES if m in df.columns]
    lines = df.select(
        *[c.alias(f"{m}_{kind}") for m in measures for kind, c in summands(F.col(m)).items()],
        *[c for c in ("order_date",) if c in df.columns],
    )
    parts = [F.count(F.lit(1)).alias("row_count")]
    for m in measures:
        value = F.col(f"{m}_value")
        parts += [F.count(value).alias(f"{m}_n"), F.avg(value).alias(f"{m}_avg"), F.var_pop(value).alias(f"{m}_spread")]
        parts += [F.sum(f"{m}_{kind}").alias(f"{m}_{kind}") for kind in ("whole", "micros", "picos")]
    if "order_date" in df.columns:
        parts += [F.min("order_date").alias("first_day"), F.max("order_date").alias("last_day")]
    return lines.agg(*parts)


def stats_from_parts(parts: DataFrame, distinct: dict[str, int], columns: int) -> DataFrame:
    """The statistics of drift_stats out of rows of stat_parts, one per batch.

    Counts and sums add up exactly; spreads about each batch's mean are moved to the mean of all.
    """
    rows = F.sum("row_count")
    values = {"row_count": rows, "column_count": F.lit(columns)}
    for m in (m for m in MEASURES if f"{m}_n" in parts.columns):
        n = F.sum(f"{m}_n")
        mean = from_parts(*(F.sum(f"{m}_{kind}") for kind in ("whole", "micros", "picos"))) / n
        values[f"{m}_mean"] = round_half_even(F.when(n > 0, mean), 4)
        each = F.filter(F.collect_list(F.struct(*[F.col(f"{m}_{k}").alias(k) for k in ("n", "avg", "spread")])), lambda b: b["n"] > 0)
        middle = F.aggregate(each, F.lit(0.0), lambda t, b: t + b["n"] * b["avg"]) / n
        about = F.aggregate(each, F.lit(0.0), lambda t, b: t + b["n"] * (b["spread"] + (b["avg"] - middle) * (b["avg"] - middle)))
        values[f"{m}_std"] = round_half_even(F.when(n > 1, F.sqrt(about / (n - 1))), 4)
        values[f"{m}_null_rate"] = round_half_even(F.when(rows > 0, (rows - n) / rows), 6)
    texts = {}
    if "first_day" in parts.columns:
        days = (("min", F.min("first_day")), ("max", F.max("last_day")))
        texts = {f"order_date_{s}": F.date_format(c, "yyyy-MM-dd") for s, c in days}
    values |= {metric: F.lit(n) for metric, n in distinct.items()}
    wide = parts.agg(*[c.cast("double").alias(m) for m, c in values.items()], *[c.alias(m) for m, c in texts.items()])
    told = [_row(m, F.col(m), None) for m in values] + [_row(m, None, F.col(m)) for m in texts]
    return wide.select(F.inline(F.array(*told)))


def _row(metric: str, value: Column | None, text: Column | None) -> Column:
    return F.struct(
        F.lit(metric).alias("metric"),
        (F.lit(None).cast("double") if value is None else value).alias("value"),
        (F.lit(None).cast("string") if text is None else text).alias("text"),
    )


def drift_findings(current: DataFrame, reference: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Metrics of ``current`` that moved by more than ``threshold`` from ``reference``.

    A metric missing on either side, or zero in the reference, is not compared.  A metric
    that has no value now or had none before (the deviation of a single row) is reported.
    """
    cur, ref = F.col("current_value"), F.col("reference_value")
    delta = F.when(ref != 0, F.abs(cur - ref) / F.abs(ref))
    both = (
        current.filter(~F.col("metric").isin(*DATES))
        .select("metric", F.col("value").alias("current_value"))
        .join(reference.select("metric", F.col("value").alias("reference_value")), "metric")
    )
    undefined = cur.isNull() | ref.isNull()
    return both.filter((F.coalesce(ref, F.lit(1.0)) != 0) & (undefined | (delta > threshold))).select(
        "metric",
        "reference_value",
        "current_value",
        round_half_even(delta * 100, 2).alias("relative_delta_pct"),
        F.lit(round(threshold * 100, 1)).alias("threshold_pct"),
    )
