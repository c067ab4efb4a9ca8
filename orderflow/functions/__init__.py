"""Column expressions shared by the operators.  All are built-in Spark expressions."""

from orderflow.functions.numeric import exact_mean, exact_sum, guarded_ratio, round_half_even
from orderflow.functions.text import na_to_null, strip, title_case, zip5

__all__ = [
    "exact_mean",
    "exact_sum",
    "guarded_ratio",
    "na_to_null",
    "round_half_even",
    "strip",
    "title_case",
    "zip5",
]
