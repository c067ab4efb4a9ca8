"""Numeric expressions whose results do not depend on how Spark splits the rows."""

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_MILLION = 1_000_000
# The first double that does not fit a bigint: what is not below it is no amount.
_LIMIT = 2.0**63


def round_half_even(c: Column, scale: int) -> Column:
    """Round as numpy does: half to even on the scaled double.

    ``F.round`` is half-up on the decimal text and differs at ties (0.125, 1.005).
    """
    factor = F.lit(float(10**scale))
    return F.rint(c.cast("double") * factor) / factor


def guarded_ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``; 0.0 for a zero denominator and NULL for a NULL one."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator / denominator)


def finite(c: Column) -> Column:
    """NULL for NaN, infinities and what is too large for any sum; all others unchanged."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(_LIMIT)), c)


def whole_part(c: Column) -> Column:
    return F.floor(c)


def _above(c: Column) -> Column:
    return (c - F.floor(c)) * F.lit(float(_MILLION))


def millionths(c: Column) -> Column:
    """What is left above ``whole_part``, as a count of millionths."""
    return F.rint(_above(c)).cast("bigint")


def trillionths(c: Column) -> Column:
    """What ``millionths`` is off by, as a count of millionths of a millionth."""
    return F.rint((_above(c) - F.rint(_above(c))) * F.lit(float(_MILLION))).cast("bigint")


def from_parts(whole: Column, micros: Column, picos: Column) -> Column:
    """The double nearest to ``whole + micros / 1e6 + picos / 1e12``."""
    micro = F.lit(Decimal("0.000001"))
    below = picos.cast("decimal(19,0)") * F.lit(Decimal("0.000000000001"))
    exact = whole.cast("decimal(24,0)") + micros.cast("decimal(19,0)") * micro + below
    return exact.cast("double")


def summands(c: Column) -> dict[str, Column]:
    """The finite value and its additive parts, to be projected before they are added."""
    value = finite(c)
    return {"value": value, "whole": whole_part(value), "micros": millionths(value), "picos": trillionths(value)}


def exact_sum(c: Column) -> Column:
    """Order-free sum as a double, good to 1e-12 per value; 0.0 over no values.

    Doubles added in another order give another result.  Whole parts, millionths and
    trillionths are added as bigints, which is exact, faster than adding decimals, and holds
    for 9e12 rows; ANSI mode raises if the whole parts ever overflow.  NaN and infinities
    count as missing.
    """
    return F.coalesce(_added(finite(c)), F.lit(0.0))


def _added(c: Column) -> Column:
    return from_parts(F.sum(whole_part(c)), F.sum(millionths(c)), F.sum(trillionths(c)))


def exact_mean(c: Column) -> Column:
    """Order-free mean of the finite values as a double; NULL over none."""
    n = F.count(finite(c))
    return F.when(n > 0, _added(finite(c)) / n)
