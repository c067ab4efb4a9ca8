"""Row ids that continue a table's numbering, and fixed-size random samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderflow.session import Stage

_INDEX_BITS = 33  # monotonically_increasing_id keeps the row's index in its low 33 bits


def next_row_id(table: DataFrame, key: str = "row_id") -> int:
    """The first free id: largest id plus one, or 1 for an empty table."""
    return (table.agg(F.max(key).alias("m")).first()["m"] or 0) + 1


def assign_row_ids(
    df: DataFrame, first_id: int, stage: Stage, order_by: list[str] | None = None
) -> DataFrame:
    """Add a gap-free ``row_id`` from ``first_id`` on; in ``order_by`` order if given.

    Rows are numbered inside their partition and shifted by the rows of the partitions
    before it, so no task ever sees more than its own partition.  The numbered rows are
    written once: partition numbers must not change between counting and shifting, also
    not when a lost executor's work is done again.
    """
    rows = df
    if order_by:
        rows = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    tag = F.monotonically_increasing_id()
    numbered = stage.put("numbered_rows", rows.withColumn("_tag", tag))
    part = F.shiftright("_tag", _INDEX_BITS)
    index = F.col("_tag").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    # One row per partition: bounded by the partition count, however large the data.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    return (
        numbered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn("row_id", F.lit(first_id) + F.col("_before") + index)
        .select("row_id", *[c for c in df.columns if c != "row_id"])
    )


def sample_rows(df: DataFrame, n: int, seed: int = 0, key: str | None = None) -> DataFrame:
    """Exactly ``n`` random rows (all, if there are fewer).

    Each task keeps its ``n`` best rows, so the driver merges small lists and nothing is
    sorted as a whole.  With a unique ``key`` the order is a hash of seed and key: the
    same rows come out on every run and engine, also when tasks are run again.
    """
    if key is None:
        return df.orderBy(F.rand(seed)).limit(n)
    shuffled = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    return df.orderBy(shuffled, F.col(key)).limit(n)
