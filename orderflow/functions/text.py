"""Text expressions with the semantics of Python's ``str`` methods.

Spark's own ``trim`` removes only U+0020 and ``initcap`` starts a word only after a
space, so both are widened here.  Everything stays inside whole-stage code generation:
no higher-order functions and no UDFs.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The texts a pandas CSV read takes for a missing value by default.
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Ends a word for title_case; a control character no source text carries.
_BREAK = "\x00"


def _printable(c: Column) -> Column:
    """Whether a text begins with a printable ASCII character other than a space."""
    return (c >= "!") & (c < "\x7f")


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace, Unicode spaces included; NULL stays NULL.

    ``btrim`` looks every character of a text up, so it only sees texts that still begin or
    end with anything but printable ASCII when their spaces are gone.
    """
    trimmed = F.trim(c)
    done = _printable(trimmed) & _printable(F.substring(trimmed, -1, 1))
    return F.when(done, trimmed).otherwise(F.btrim(trimmed, F.lit(WHITESPACE)))


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every run of letters and lower-case the rest.

    ``initcap`` only restarts after a space, so a break and a space are put behind every
    character that is neither a letter nor a space, and taken out again afterwards.  ASCII texts
    in which no letter stands right behind such a character need no break.
    """
    kinds = F.mask(F.replace(c, F.lit(" "), F.lit("a")), F.lit("a"), F.lit("a"), F.lit("0"), F.lit("0"))
    plain = (F.octet_length(c) == F.length(c)) & ~F.contains(kinds, F.lit("0a"))
    marked = F.regexp_replace(c, r"([^\p{IsLowercase}\p{IsUppercase}\p{Lt} ])", "$1" + _BREAK + " ")
    return F.when(plain, F.initcap(c)).otherwise(F.replace(F.initcap(marked), F.lit(_BREAK + " "), F.lit("")))


def zip5(c: Column) -> Column:
    """Postal code as text: no float tail, all-digit codes zero-padded to five.

    Longer codes are kept whole (``lpad`` alone would cut them) and NULL stays NULL.
    """
    text = c.cast("string")
    # The pattern also takes a tail before a final line break.
    code = (
        F.when(F.endswith(text, F.lit(".0")), F.substring(text, F.lit(1), F.length(text) - 2))
        .when(F.contains(text, F.lit(".0")), F.regexp_replace(text, r"\.0$", ""))
        .otherwise(text)
    )
    return F.when((F.length(code) < 5) & code.rlike("^[0-9]+$"), F.lpad(code, 5, "0")).otherwise(code)


def na_to_null(c: Column) -> Column:
    """NULL for every text that stands for a missing value in the source files."""
    return F.when(~c.isin(*NA_TOKENS), c)
