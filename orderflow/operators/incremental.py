"""Insert-only loading: new rows by key, by-name append, and the date high-water mark."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_size(batch: DataFrame, key: str) -> int:
    """Measured bytes of the batch's keys, the bound new_rows checks before broadcasting."""
    width = F.octet_length(F.col(key).cast("string")) + 16
    return batch.agg(F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()["bytes"]


def new_rows(
    batch: DataFrame, fact: DataFrame, key: str = "row_id", broadcast_keys: bool = False
) -> DataFrame:
    """Batch rows whose key is not in the fact.

    Every row of a new key comes through, also several with the same key; a known key is
    dropped whatever its other values are; a NULL key matches nothing.  NULL keys skip the
    join, so many of them cannot pile up in one join partition.

    ``broadcast_keys`` is for a batch whose keys were measured to be small: the fact is
    then reduced to the batch's keys by a broadcast semi join, which scans its key column
    once and never shuffles it.  The reduced side has at most the batch's distinct keys.
    Without it the planner joins by shuffle and splits hot keys at run time.
    """
    keyed = batch.filter(F.col(key).isNotNull())
    known = fact.select(key).filter(F.col(key).isNotNull())
    if broadcast_keys:
        wanted = keyed.select(key).distinct()
        known = F.broadcast(known.join(F.broadcast(wanted), key, "left_semi").distinct())
    fresh = keyed.join(known, key, "left_anti").select(*batch.columns)
    return fresh.unionByName(batch.filter(F.col(key).isNull()))


def fits_broadcast(batch: DataFrame, key: str) -> bool:
    """Whether the measured keys stay under the session's own broadcast limit."""
    conf = batch.sparkSession.conf
    limit = _bytes(conf.get("spark.sql.autoBroadcastJoinThreshold"))
    return limit > 0 and key_size(batch, key) <= limit


def _bytes(text: str) -> int:
    """A Spark byte setting ("10485760", "10MB", "2m") as a number."""
    text = text.strip().lower().removesuffix("b")
    units = {"k": 2**10, "m": 2**20, "g": 2**30}
    if text and text[-1] in units:
        return int(text[:-1]) * units[text[-1]]
    return int(text)


def align_by_name(batch: DataFrame, target: DataFrame) -> DataFrame:
    """The batch in the target's columns, order and types.

    A column the batch lacks becomes NULL; a column the target lacks is an error.
    """
    unknown = [c for c in batch.columns if c not in target.columns]
    if unknown:
        raise ValueError(f"columns not in the target table: {unknown}")
    return batch.select(
        *[
            (F.col(f.name) if f.name in batch.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target.schema.fields
        ]
    )


def append_by_name(target: DataFrame, batch: DataFrame) -> DataFrame:
    return target.unionByName(align_by_name(batch, target))


def incremental_fact(fact: DataFrame | None, batch: DataFrame, key: str = "row_id") -> DataFrame:
    """The fact after loading ``batch``; without a fact the batch is the fact.

    The batch's keys are measured first: while they are small the fact is never shuffled.
    """
    if fact is None:
        return batch
    small = fits_broadcast(batch, key)
    return append_by_name(fact, new_rows(batch, fact, key, broadcast_keys=small))


def watermark_candidate(batch: DataFrame, column: str = "order_date") -> DataFrame:
    """One row: the newest order date of the batch as ISO text, NULL for an empty batch."""
    return batch.agg(F.date_format(F.max(column), "yyyy-MM-dd").alias("watermark"))


def later(old: date | None, new: date | None) -> date | None:
    """The high-water mark after a run; it never moves back."""
    return max((d for d in (old, new) if d is not None), default=None)
