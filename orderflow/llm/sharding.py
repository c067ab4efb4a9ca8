"""Shards of near-equal size by sampled splitters.

A size-weighted sample of keys gives quantile boundaries; records are range-partitioned by
them, and a range that turns out overfull is divided again by boundaries sampled inside it.
Each range is small enough for one task, so exact running sizes inside the ranges, on top of
the ranges' own totals, place every record.  DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderflow.llm.common import given_back, hash_text, new_name, set_aside, text_of, without
from orderflow.session import Stage

ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
KEYS = ("_copy_key", "_doc_key", "_size", "_crc")


def _keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    return without(docs, *KEYS).withColumns(
        {
            "_copy_key": hash_text(text_of(text)),
            "_doc_key": hash_text(key),
            "_size": F.octet_length(text_of(text)).cast("long") + 8,
            "_crc": F.crc32(text_of(text)),
        }
    )


def _sampled(rows: DataFrame, share: Column) -> DataFrame:
    """Rows drawn with probability size x share, by a hash, so that reruns draw the same."""
    dice = F.conv(F.substring(F.md5(F.concat("_copy_key", "_doc_key")), 1, 12), 16, 10)
    return rows.where(dice.cast("double") / float(16**12) < F.col("_size") * share)


def _quantiles(sample: DataFrame, by: list[str], order: list[str], step: int) -> DataFrame:
    ranked = sample.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("_rank") % step == 0).drop("_rank")


def _range_of(bounds: list[str]) -> Column:
    """How many boundaries are at or below the key: first among fences, then behind one."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    fence = F.size(F.filter(F.lit([g[0] for g in groups]), lambda b: b <= F.col("_copy_key")))
    inner = F.element_at(F.array(*(F.lit(g) for g in groups)), F.greatest(fence, F.lit(1)))
    within = F.size(F.filter(inner, lambda b: b <= F.col("_copy_key")))
    return F.when(fence == 0, 0).otherwise((fence - 1) * width + within)


def shard(
    docs: DataFrame,
    shards: int = 24,
    text: str = "text",
    key: str = "doc_id",
    ranges_per_shard: int = 64,
    draws_per_range: int = 8,
    whole_copies: float = 0.005,
) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot and grown_shard.

    Records are ordered by (hash of the text, hash of the key), so equal texts are
    neighbours.  Shards are consecutive stretches of that order with near-equal bytes: a
    record goes where its middle byte falls.  Equal texts stay in one shard if together they
    are at most ``whole_copies`` of a shard; a larger group may be cut anywhere, so a text
    that holds a third of all rows is spread over many shards.

    The boundaries that are collected number shards x ranges_per_shard, whatever the input.
    NULL text: 8 bytes, crc of nothing.  NULL keys and repeated rows are records like any
    other, texts of any length count whole.  Columns named like an added one are replaced, all
    others, whatever their names, are handed through.  An empty table gives no rows.
    """
    base, names = set_aside(without(docs, *ADDED))
    found = _sharded(base, shards, new_name(names, text), new_name(names, key), ranges_per_shard, draws_per_range, whole_copies)
    return found.select(*given_back(names), *ADDED)


def _sharded(
    docs: DataFrame, shards: int, text: str, key: str, ranges_per_shard: int, draws_per_range: int, whole_copies: float
) -> DataFrame:
    stage = Stage(docs.sparkSession)
    slim = stage.put("keys", _keyed(docs, text, key).select(*KEYS[:3]))
    total = slim.agg(F.sum("_size")).first()[0] or 0
    ranges = shards * ranges_per_shard
    goal = max(total / ranges, 1.0)

    drawn = _sampled(slim, F.lit(draws_per_range / goal)).withColumn("_all", F.lit(0))
    quantiles = _quantiles(drawn, ["_all"], ["_copy_key"], draws_per_range)
    bounds = sorted({r[0] for r in quantiles.select("_copy_key").collect()})
    ranged = slim.withColumn("_range", _range_of(bounds))

    # Boundaries inside overfull ranges.  One that falls alone into a group of copies moves to
    # the group's start; a group that several fall into is divided by the records' own keys.
    overfull = (
        ranged.groupBy("_range").agg(F.sum("_size").alias("_bytes")).where(F.col("_bytes") > 2 * goal)
    )
    inside = _sampled(ranged.join(F.broadcast(overfull), "_range"), F.lit(2 * draws_per_range / goal))
    cuts = _quantiles(inside, ["_range"], ["_copy_key", "_doc_key"], 2 * draws_per_range)
    alone = F.count("*").over(Window.partitionBy("_range", "_copy_key")) == 1
    start = F.when(F.col("_alone"), "").otherwise(F.col("_doc_key"))
    divided = stage.put(
        "cuts",
        cuts.withColumn("_alone", alone)
        .groupBy("_range")
        .agg(
            F.array_sort(F.collect_set(F.concat("_copy_key", start))).alias("_cuts"),
            F.collect_set(F.when(~F.col("_alone"), F.col("_copy_key"))).alias("_split"),
        ),
    )

    def parts(rows: DataFrame) -> DataFrame:
        own = F.concat("_copy_key", "_doc_key")
        return (
            rows.withColumn("_range", _range_of(bounds))
            .join(F.broadcast(divided), "_range", "left")
            .withColumn("_part", F.coalesce(F.size(F.filter("_cuts", lambda c: c <= own)), F.lit(0)))
            .withColumn("_part", F.greatest("_part", F.lit(0)))
            .withColumn("_apart", F.coalesce(F.array_contains("_split", F.col("_copy_key")), F.lit(False)))
            .drop("_cuts", "_split")
        )

    before = Window.orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage.put(
        "offsets",
        parts(slim)
        .groupBy("_range", "_part")
        .agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"))
        .select(
            "_range",
            "_part",
            F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        ),
    )
    in_part = Window.partitionBy("_range", "_part")
    ordered = in_part.orderBy("_copy_key", "_doc_key", "_size")
    copies = Window.partitionBy("_range", "_part", "_copy_key")

    def placed(rows: DataFrame) -> DataFrame:
        own = F.sum("_size").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
        whole = (F.col("_group") <= whole_copies * total / shards) & ~F.col("_apart")
        middle = F.when(whole, F.col("_first") * 2 + F.col("_group")).otherwise(
            F.col("_at") * 2 + F.col("_size")
        )
        return (
            parts(rows)
            .join(F.broadcast(offsets), ["_range", "_part"])
            .withColumns(
                {
                    "_at": F.col("_bytes_before") + own,
                    "_row": F.col("_rows_before") + F.row_number().over(ordered) - 1,
                }
            )
            .withColumns({"_group": F.sum("_size").over(copies), "_first": F.min("_at").over(copies)})
            .withColumn(
                "_shard",
                F.least(F.floor(middle * shards / (2 * max(total, 1))), F.lit(shards - 1)).cast("int"),
            )
            .drop("_bytes_before", "_rows_before", "_group", "_first", "_at", "_apart")
        )

    firsts = stage.put("firsts", placed(slim).groupBy("_shard").agg(F.min("_row").alias("_start")))
    result = placed(_keyed(docs, text, key)).join(F.broadcast(firsts), "_shard")
    return result.withColumns(
        {
            "size": F.col("_size"),
            "text_crc32": F.col("_crc"),
            "law": F.lit("bytes"),
            "shard": F.col("_shard"),
            "slot": F.col("_row") - F.col("_start"),
            "grown_shard": F.lit(None).cast("int"),
        }
    ).drop("_shard", "_row", "_start", "_range", "_part", *KEYS)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; rows keep the range partitioning they were placed by."""
    sharded.write.mode("overwrite").partitionBy("shard").parquet(path)
