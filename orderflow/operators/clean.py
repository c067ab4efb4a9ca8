"""Cleaning: text, postal codes, dates, duplicates, numbers -- in that order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.functions import strip, title_case, zip5
from orderflow.functions.numeric import finite
from orderflow.operators.dedup import drop_full_duplicates, drop_staged_duplicates
from orderflow.schema import DEFAULT_SCHEMA, TITLE_CASED, SourceSchema
from orderflow.session import Stage

DATE_FORMAT = "M/d/yyyy"


def _present(df: DataFrame, names: Iterable[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def strip_whitespace(df: DataFrame) -> DataFrame:
    """Strip every string column."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({n: strip(F.col(n)) for n in text})


def normalise_categoricals(df: DataFrame, columns: Iterable[str] = TITLE_CASED) -> DataFrame:
    """Title-case the categorical columns; absent ones are skipped."""
    return df.withColumns({n: title_case(F.col(n)) for n in _present(df, columns)})


def fix_postal_codes(df: DataFrame, column: str = "postal_code") -> DataFrame:
    return df.withColumns({n: zip5(F.col(n)) for n in _present(df, [column])})


def parse_dates(
    df: DataFrame,
    columns: Iterable[str] = ("order_date", "ship_date"),
    date_format: str = DATE_FORMAT,
) -> DataFrame:
    """Parse text dates; a text that does not fit the format fails the next action."""
    return df.withColumns({n: F.to_date(F.col(n), date_format) for n in columns})


def _whole_number(c: Column) -> Column:
    """Text to bigint, also where it is spelled as a float ("2.0", "2e3"); else NULL.

    Digits followed by a point and zeros are read as text, so no digit of a long id is lost.
    Only the form with an exponent goes over a double, as far as doubles are whole numbers.
    """
    digits = F.regexp_extract(c, r"^\s*([-+]?[0-9]+)\.0*\s*$", 1)
    number = c.try_cast("double")
    whole = c.rlike("[eE]") & (number == F.rint(number)) & (F.abs(number) < 2.0**53)
    return F.coalesce(c.try_cast("bigint"), digits.try_cast("bigint"), F.when(whole, number).cast("bigint"))


def cast_numerics(df: DataFrame, schema: SourceSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Type the number columns; text that is no such number becomes NULL."""
    typed = {}
    for rule in (r for r in schema.rules if r.name in df.columns):
        c = F.col(rule.name)
        if isinstance(rule.raw_type, T.DoubleType):
            typed[rule.name] = finite(c.try_cast("double"))
        elif isinstance(rule.raw_type, T.LongType):
            text = isinstance(df.schema[rule.name].dataType, T.StringType)
            typed[rule.name] = _whole_number(c) if text else c.try_cast("bigint")
    return df.withColumns(typed)


def normalise_text(df: DataFrame) -> DataFrame:
    """The cleaning of text but for dates; columns that are not there are skipped."""
    return df.transform(strip_whitespace).transform(normalise_categoricals).transform(fix_postal_codes)


def normalise(df: DataFrame, date_format: str = DATE_FORMAT) -> DataFrame:
    """The row-wise cleaning steps before duplicates are dropped.  No shuffle."""
    return df.transform(normalise_text).transform(parse_dates, date_format=date_format)


def clean(
    df: DataFrame,
    date_format: str = DATE_FORMAT,
    deduplicate: bool = True,
    schema: SourceSchema = DEFAULT_SCHEMA,
    stage: Stage | None = None,
) -> DataFrame:
    """Raw order lines to typed, de-duplicated order lines.

    ``deduplicate=False`` leaves out the full-row shuffle for a caller who has already
    shown that the normalised rows hold no duplicate (see operators.dedup).  With a ``stage``
    the rows are staged and shuffled as digests only.
    """
    rows = normalise(df, date_format)
    if deduplicate:
        rows = drop_staged_duplicates(rows, stage) if stage else drop_full_duplicates(rows)
    return cast_numerics(rows, schema)
