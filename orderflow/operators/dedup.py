"""Full-row duplicates: dropping, counting, and proving there are none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.session import Stage

# Rows of one bitmap, as bitmap_construct_agg makes them, and how many of its 4 KB may be broadcast.
_BITS = 15
_BROADCAST = 16_384


def drop_full_duplicates(df: DataFrame) -> DataFrame:
    """One row of every identical set.

    Runs as partial and final aggregation, so a set of copies that holds a third of all
    rows shrinks to one row per input task before the shuffle.
    """
    return df.dropDuplicates()


def drop_staged_duplicates(df: DataFrame, stage: Stage, name: str = "numbered") -> DataFrame:
    """One row of every identical set, like ``drop_full_duplicates``, without a shuffle of whole rows.

    Rows are staged with a number.  Only the SHA-256 of a row's values and its number are shuffled;
    the least number of each digest is kept, as a bit of a bitmap that is broadcast (a bit a row) to
    the staged rows.  Copies shrink before the shuffle.  Rows with columns of other types than
    plain values are shuffled whole.
    """
    told = [_told(f) for f in df.schema.fields]
    if not told or any(t is None for t in told):
        return drop_full_duplicates(df)
    row = "_row"
    while row.lower() in {c.lower() for c in df.columns}:
        row = f"_{row}"
    rows = stage.put(name, df.withColumn(row, F.monotonically_increasing_id()))
    digest = F.unhex(F.sha2(F.concat(*told), 256))
    first = rows.select(digest.alias("digest"), F.col(row).alias("row")).groupBy("digest").agg(F.min("row").alias("row"))
    first = first.select(F.shiftright("row", _BITS).alias("bucket"), F.col("row").bitwiseAND(F.lit((1 << _BITS) - 1)).alias("bit"))
    kept = first.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    kept = stage.put(f"{name}_kept", kept.select(F.col("bucket").alias(f"{row}_bucket"), F.col("bits").alias(f"{row}_bits")))
    if kept.count() <= _BROADCAST:
        kept = F.broadcast(kept)
    bit = F.col(row).bitwiseAND(F.lit((1 << _BITS) - 1))
    byte = F.hex(F.substring(F.col(f"{row}_bits"), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1)))
    digit = F.substring(byte, F.when(bit.bitwiseAND(F.lit(4)) > 0, 1).otherwise(2), F.lit(1))
    is_kept = F.getbit(F.instr(F.lit("0123456789ABCDEF"), digit) - 1, bit.bitwiseAND(F.lit(3)).cast("int")) == 1
    joined = rows.join(kept, F.shiftright(F.col(row), _BITS) == F.col(f"{row}_bucket"))
    return joined.filter(is_kept).select(*[F.col(f"`{c}`") for c in df.columns])


def _told(field: T.StructField) -> Column | None:
    """A value as text, behind its length, so that different rows give different texts; None if unknown.

    Equal are the values that Spark groups together: both zeros, and all that are no number.
    """
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        text = (c + F.lit(0.0).cast(kind)).cast("string")
    elif isinstance(kind, T.BinaryType):
        text = F.hex(c)
    elif isinstance(kind, T.TimestampType):
        text = F.unix_micros(c).cast("string")
    elif isinstance(kind, T.DateType):
        text = F.unix_date(c).cast("string")
    elif isinstance(kind, (T.IntegralType, T.DecimalType, T.BooleanType, T.TimestampNTZType)) or kind == T.StringType():
        text = c.cast("string")
    else:
        return None
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: how many rows lie beyond the first of their identical set."""
    sets = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    return sets.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def has_repeated_fingerprint(df: DataFrame) -> bool:
    """False proves that no two rows are identical, at the cost of a 16-byte shuffle.

    Equal rows share their 64-bit fingerprint, so when no fingerprint repeats there is no
    duplicate and the full-width shuffle of ``dropDuplicates`` can be left out.  True says
    nothing certain (fingerprints may collide): run the exact step then.
    """
    prints = df.select(F.xxhash64(*df.columns).alias("fp")).groupBy("fp").count()
    return not prints.filter(F.col("count") > 1).isEmpty()


def count_duplicates(df: DataFrame) -> int:
    """The exact number of surplus rows; the wide shuffle runs only if it may be non-zero."""
    if not has_repeated_fingerprint(df):
        return 0
    return duplicate_count(df).first()["duplicate_rows"]
