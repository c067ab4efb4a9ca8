"""Data-quality checks: a report with one row per check, and the gate on it.

Nulls, value ranges and the date rule are one aggregation; unexpected values and
duplicate rows group first and so need one shuffle each.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.functions.numeric import finite
from orderflow.operators.dedup import count_duplicates, duplicate_count
from orderflow.schema import DEFAULT_SCHEMA, ColumnRule, SourceSchema
from orderflow.session import concurrently


class QualityGateError(RuntimeError):
    """A quality report failed and the run is set to stop on that."""


def _value(df: DataFrame, name: str) -> Column:
    """The column with NaN and infinities taken as missing."""
    floating = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    return finite(F.col(name)) if floating else F.col(name)


def _check(number: int, name: str, failures: Column, details: Column) -> Column:
    return F.struct(
        F.lit(number).alias("check_no"),
        F.lit(name).alias("check_name"),
        (F.coalesce(F.length(details), F.lit(0)) == 0).alias("passed"),
        failures.cast("bigint").alias("failures"),
        details.alias("details"),
    )


def _messages(messages: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """(how many apply, their texts joined) for pairs of a condition and a text."""
    if not messages:
        return F.lit(0), F.lit("")
    count = reduce(lambda a, b: a + b, [F.when(cond, 1).otherwise(0) for cond, _ in messages])
    return count, F.concat_ws("; ", *[F.when(cond, text) for cond, text in messages])


def _bound_text(df: DataFrame, name: str, bound: float) -> str:
    integral = isinstance(df.schema[name].dataType, (T.LongType, T.IntegerType))
    return str(int(bound)) if integral and float(bound).is_integer() else str(float(bound))


def _columnwise_checks(
    df: DataFrame, rules: list[ColumnRule], missing: list[str], date_checks: bool
) -> DataFrame:
    """Schema, null, range and date checks: one row each, one pass over the data."""
    counts: dict[str, Column] = {}
    nulls, ranges = [], []
    for rule in rules:
        c = _value(df, rule.name)
        if not rule.nullable:
            counts[f"null_{rule.name}"] = F.count_if(c.isNull())
            n = F.col(f"null_{rule.name}")
            nulls.append((n > 0, F.format_string(f"{rule.name}: %d nulls", n)))
        for side, bound in (("min", rule.min_value), ("max", rule.max_value)):
            if bound is None:
                continue
            counts[f"{side}_{rule.name}"] = F.count_if(c < bound if side == "min" else c > bound)
            n = F.col(f"{side}_{rule.name}")
            where = "below" if side == "min" else "above"
            text = f"{rule.name}: %d rows {where} {side} {_bound_text(df, rule.name, bound)}"
            ranges.append((n > 0, F.format_string(text, n)))

    checks = [
        _check(
            1,
            "schema_columns",
            F.lit(len(missing)),
            F.lit(f"missing columns: {missing}" if missing else ""),
        ),
        _check(2, "null_check", *_messages(nulls)),
        _check(3, "value_ranges", *_messages(ranges)),
    ]
    if date_checks:
        dates = [df.schema[c].dataType for c in ("order_date", "ship_date") if c in df.columns]
        if len(dates) == 2 and all(isinstance(d, (T.DateType, T.TimestampType)) for d in dates):
            counts["ship_first"] = F.count_if(F.col("ship_date") < F.col("order_date"))
            n = F.col("ship_first")
            text = F.format_string("%d rows where ship_date < order_date", n)
            checks.append(_check(6, "ship_after_order", n, F.when(n > 0, text).otherwise("")))
        else:
            text = "date columns must be parsed before this check can run"
            checks.append(_check(6, "ship_after_order", F.lit(0), F.lit(text)))

    counts = counts or {"rows": F.count(F.lit(1))}
    one_row = df.agg(*[c.alias(name) for name, c in counts.items()])
    return one_row.select(F.inline(F.array(*checks)))


def rogue_values(df: DataFrame, rules: list[ColumnRule]) -> DataFrame:
    """(position, column_name, value, rows): every value outside its column's allowed set."""
    found = [
        F.when(
            F.col(r.name).isNotNull() & ~F.col(r.name).isin(*r.allowed),
            F.struct(
                F.lit(i).alias("position"),
                F.lit(r.name).alias("column_name"),
                F.col(r.name).alias("value"),
            ),
        )
        for i, r in enumerate(rules)
        if r.allowed
    ]
    if not found:
        return df.sparkSession.createDataFrame(
            [], "position int, column_name string, value string, rows bigint"
        )
    return (
        df.select(F.inline(F.array_compact(F.array(*found))))
        .groupBy("position", "column_name", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def _allowed_values_check(df: DataFrame, rules: list[ColumnRule]) -> DataFrame:
    """One report row with exact counts per column; rogue_values() has every value."""
    per_column = (
        rogue_values(df, rules)
        .groupBy("position", "column_name")
        .agg(F.count(F.lit(1)).alias("distinct_values"), F.sum("rows").alias("lines"))
    )
    text = F.format_string("%s: %d unexpected values in %d rows", "column_name", "distinct_values", "lines")
    violations = per_column.agg(
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.struct("position", text.alias("text")))).alias("texts"),
    )
    return violations.select(
        F.inline(
            F.array(_check(4, "allowed_values", F.col("n"), F.array_join("texts.text", "; ")))
        )
    )


def _duplicate_check(df: DataFrame, duplicate_rows: int | None) -> DataFrame:
    """One report row; a count the caller already has is taken over."""
    if duplicate_rows is None:
        counted = duplicate_count(df)
    else:
        counted = df.sparkSession.range(1).select(F.lit(duplicate_rows).alias("duplicate_rows"))
    n = F.col("duplicate_rows")
    text = F.when(n > 0, F.format_string("%d fully-duplicated rows detected", n.cast("bigint")))
    return counted.select(
        F.inline(F.array(_check(5, "duplicate_rows", n, F.coalesce(text, F.lit("")))))
    )


def quality_report(
    df: DataFrame,
    schema: SourceSchema = DEFAULT_SCHEMA,
    date_checks: bool = False,
    duplicate_rows: int | None = None,
) -> DataFrame:
    """One row per check: check_no, check_name, passed, failures, details.

    Five checks, six with ``date_checks`` (which need parsed dates).  ``failures`` counts
    columns for the schema, null and value checks, bounds for ranges, and rows for the
    duplicate and date checks.
    """
    missing = sorted(n for n in schema.names if n not in df.columns)
    rules = [r for r in schema.rules if r.name in df.columns]
    return (
        _columnwise_checks(df, rules, missing, date_checks)
        .unionByName(_allowed_values_check(df, rules))
        .unionByName(_duplicate_check(df, duplicate_rows))
    )


def summarise(report: DataFrame) -> DataFrame:
    """One row: total, passed and failed checks, and whether all passed."""
    return report.agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if("passed").alias("passed_checks"),
        F.count_if(~F.col("passed")).alias("failed_checks"),
        F.bool_and("passed").alias("overall_passed"),
    )


def checked(
    df: DataFrame,
    schema: SourceSchema = DEFAULT_SCHEMA,
    date_checks: bool = False,
    proven: Callable[[], bool] = lambda: False,
) -> list[dict]:
    """The rows of quality_report; its three passes run at once, the duplicates by fingerprint.

    ``proven`` tells whether the caller has shown that no two rows are alike.
    """
    missing = sorted(n for n in schema.names if n not in df.columns)
    rules = [r for r in schema.rules if r.name in df.columns]
    columnwise, allowed, duplicates = concurrently(
        df.sparkSession,
        _columnwise_checks(df, rules, missing, date_checks).collect,
        _allowed_values_check(df, rules).collect,
        lambda: 0 if proven() else count_duplicates(df),
    )
    rows = [*columnwise, *allowed, *_duplicate_check(df, duplicates).collect()]
    return sorted((row.asDict() for row in rows), key=lambda c: c["check_no"])


def gate(report: DataFrame, stage: str, fail_on_error: bool = True) -> dict:
    """Run the report (at most six rows reach the driver) and stop on a failed check."""
    return judge([row.asDict() for row in report.orderBy("check_no").collect()], stage, fail_on_error)


def judge(checks: list[dict], stage: str, fail_on_error: bool = True) -> dict:
    """The outcome of a report's rows; raises on a failed check if told to."""
    failed = [c for c in checks if not c["passed"]]
    outcome = {
        "stage": stage,
        "passed": not failed,
        "total_checks": len(checks),
        "failed_checks": len(failed),
        "checks": checks,
    }
    if failed and fail_on_error:
        told = "; ".join(f"{c['check_name']} ({c['details']})" for c in failed)
        raise QualityGateError(f"quality gate failed on {stage} data: {told}")
    return outcome
