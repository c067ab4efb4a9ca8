"""Aggregate tables kept up to date from a state and the rows it has not seen.

A table's state is its additive parts per key and, for each id it counts, the distinct pairs of
key and id.  A batch adds its parts; of its pairs only those the state lacks are counted and
stored.  So a load reads the batch and the pairs of the state, never the fact.  The statistics that
drift is measured by are kept in the same way.

The state of a fact is a chain of versions under ``gold_state``.  A version holds the sums over all
batches so far and the pairs its own batches added.  Its row in ``versions/gold_state``, written
last, says up to which batch of which fact it reaches: a merge that broke left no row and is done
again, one that is done is never done twice.
"""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.operators import drift
from orderflow.plans import gold
from orderflow.plans.gold import PARTS, GoldTable, line_parts, roll_up
from orderflow.session import Stage, concurrently, delete_folder, folders_in, path_exists
from orderflow.sources.lake import FACT, Lake

CHAIN = "version string, written_at timestamp, fact_version string, upto string, whole boolean"
EVERY = "every_line"
LONGEST = 50  # versions in a chain before all pairs are written into one


def statistics(lake: Lake) -> DataFrame | None:
    """The drift statistics of the whole fact, from what each batch left; None without a state."""
    chain = rows_of(lake, lake.version(FACT)) if lake.version(FACT) else []
    if not chain or chain[-1]["upto"] != lake.batches(FACT)[-1]:
        return None
    spark, fact = lake.spark, lake.read(FACT)
    folders = [f"{lake.root}/gold_state/{r['version']}" for r in chain]
    distinct = {
        metric: spark.read.schema(fact.select(c).schema).parquet(*(f"{f}/pairs/{EVERY}/{c}" for f in folders)).count()
        for metric, c in drift.DISTINCT.items()
        if c in fact.columns
    }
    return drift.stats_from_parts(spark.read.parquet(*(f"{f}/stats" for f in folders)), distinct, len(fact.columns))


def distinct_pairs(table: GoldTable, parts: DataFrame, column: str) -> DataFrame:
    """The table's keys with each id they occur with, once; no pair has a NULL."""
    pair = [*table.keys, column]
    return parts.dropna(subset=pair).select(*pair).distinct()


def unseen(pairs: DataFrame, known: DataFrame | None) -> DataFrame:
    """The pairs a state does not hold.

    The state is cut down to the batch's pairs first, in one scan of its columns; the planner
    broadcasts the batch's side while its size allows.
    """
    if known is None:
        return pairs
    columns = pairs.columns
    return pairs.join(known.join(pairs, columns, "left_semi"), columns, "left_anti")


def counted(table: GoldTable, sums: DataFrame | None, parts: DataFrame, fresh: dict[str, DataFrame]) -> DataFrame:
    """The sums of a state with a batch's parts and new pairs added, a row per key.

    Lines, pairs and sums meet in one aggregation, so each is shuffled once, added up before.
    """
    names = [*PARTS, *(f"{c}_n" for c in fresh)]
    rows = [parts.dropna(subset=list(table.keys)).select(*table.keys, *PARTS)] + [
        pairs.select(*table.keys, F.lit(1).cast("bigint").alias(f"{column}_n")) for column, pairs in fresh.items()
    ]
    whole = sums
    for df in rows:
        whole = df if whole is None else whole.unionByName(df, allowMissingColumns=True)
    for name in names:
        if name not in whole.columns:
            whole = whole.withColumn(name, F.lit(None).cast("bigint"))
    return whole.groupBy(*table.keys).agg(*[F.sum(n).alias(n) for n in names])


def rows_of(lake: Lake, fact_version: str) -> list:
    """The chain of a fact's state, oldest first; empty if a part of it is gone."""
    pointer = f"{lake.root}/versions/gold_state"
    if not path_exists(lake.spark, pointer):
        return []
    found = lake.spark.read.schema(CHAIN).parquet(pointer).where(F.col("fact_version") == fact_version)
    chain: list = []
    for row in found.orderBy("written_at", "version").collect():
        chain = [row] if row["whole"] else [*chain, row]
    folders = set(folders_in(lake.spark, f"{lake.root}/gold_state"))
    return chain if all(r["version"] in folders for r in chain) else []


def renew(lake: Lake, stage: Stage, key: str = "row_id") -> list[str]:
    """Bring the state up to the fact's last batch and write the five tables from it."""
    spark, version = lake.spark, lake.version(FACT)
    chain, batches = rows_of(lake, version), lake.batches(FACT)
    applied = chain[-1]["upto"] if chain else None
    if applied is not None and applied not in batches:
        chain, applied = [], None
    pending = batches[batches.index(applied) + 1 :] if chain else batches
    state = f"{lake.root}/gold_state"
    current = chain[-1]["version"] if chain else None
    if pending:
        whole = not chain or len(chain) >= LONGEST
        current = _merge(lake, stage, key, chain, pending, whole)
        row = spark.range(1).select(
            F.lit(current).alias("version"),
            F.current_timestamp().alias("written_at"),
            F.lit(version).alias("fact_version"),
            F.lit(batches[-1]).alias("upto"),
            F.lit(whole).alias("whole"),
        )
        row.coalesce(1).write.mode("append").parquet(f"{lake.root}/versions/gold_state")
        kept = {current} if whole else {current, *(r["version"] for r in chain)}
        for old in folders_in(spark, state):
            if old not in kept:
                delete_folder(spark, f"{state}/{old}")
    tables = {t.name: t.from_sums(spark.read.parquet(f"{state}/{current}/sums/{t.name}")) for t in gold.GOLD}
    concurrently(spark, *[partial(lake.replace, name, df) for name, df in tables.items()])
    return list(tables)


def _merge(lake: Lake, stage: Stage, key: str, chain: list, pending: list[str], whole: bool) -> str:
    """Write a version of the state that holds the pending batches too; returns its name."""
    spark, state, version = lake.spark, f"{lake.root}/gold_state", f"s-{uuid.uuid4().hex}"
    lines = lake.read_batches(FACT, pending)
    delta = line_parts(lines, key)
    # The three order tables share a roll-up to about a row per order.
    rolled = stage.put("order_rollup", roll_up(delta, list(dict.fromkeys(c for t in gold.ORDER_TABLES for c in t.grain))))
    source = {t: rolled if t in gold.ORDER_TABLES else delta for t in gold.GOLD}
    # Ids without a key are what the drift statistics count.
    every = GoldTable(EVERY, (), (), ())
    source[every] = lines
    counts = [(t, c) for t in gold.GOLD for c in t.distinct_ids]
    counts += [(every, c) for c in drift.DISTINCT.values() if c in lines.columns]

    def place(of: str, table: GoldTable, column: str) -> str:
        return f"{state}/{of}/pairs/{table.name}/{column}"

    def write_stats() -> None:
        drift.stat_parts(lines).write.parquet(f"{state}/{version}/stats")
        if whole and chain:
            known = spark.read.parquet(*(f"{state}/{r['version']}/stats" for r in chain))
            known.write.mode("append").parquet(f"{state}/{version}/stats")

    def write_pairs(table: GoldTable, column: str) -> None:
        pairs, known = distinct_pairs(table, source[table], column), None
        if chain:
            known = spark.read.schema(pairs.schema).parquet(*(place(r["version"], table, column) for r in chain))
        pairs = stage.put(f"pairs_{table.name}_{column}", pairs) if chain else pairs
        fresh = unseen(pairs, known)
        fresh.write.parquet(place(version, table, column))
        if whole and chain:
            known.write.mode("append").parquet(place(version, table, column))

    def write_sums(table: GoldTable) -> None:
        fresh = {c: spark.read.parquet(place(version, table, c)) for c in table.distinct_ids}
        sums = None
        if chain and not whole:
            sums = spark.read.parquet(f"{state}/{chain[-1]['version']}/sums/{table.name}")
        elif chain:
            # All pairs are counted anew; the parts go on from the sums.
            sums = spark.read.parquet(f"{state}/{chain[-1]['version']}/sums/{table.name}").drop(
                *(f"{c}_n" for c in table.distinct_ids)
            )
        counted(table, sums, source[table], fresh).write.parquet(f"{state}/{version}/sums/{table.name}")

    concurrently(spark, write_stats, *[partial(write_pairs, t, c) for t, c in counts])
    concurrently(spark, *[partial(write_sums, t) for t in gold.GOLD])
    return version
