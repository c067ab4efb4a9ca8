"""The tables of one deployment as Parquet folders under a root path.

    <root>/fact_sales/<version>     order lines of the first load, partitioned by order month
    <root>/fact_sales/<batch>       those of a later load, laid out alike
    <root>/gold_state/<version>     what the aggregate tables are kept up to date from
    <root>/gold/<name>/<version>    the five aggregate tables
    <root>/profile/<name>/<version> the last profile
    <root>/versions/<name>          which version of a table holds; the newest row counts
    <root>/state, stats, runs, rogue_values, files   append-only bookkeeping

A replacement is written to a new version and becomes the table only by its row in
``versions``, written last.  One that breaks leaves the table as it was.  So does a batch: its
folder is part of the fact only by its row, and a repeat is written to a folder of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from orderflow.plans.gold import GOLD
from orderflow.schema import DEFAULT_SCHEMA, DERIVED, SourceSchema
from orderflow.session import delete_folder, folders_in, path_exists

MONTH = "order_month_start"
FACT = "fact_sales"
GOLD_NAMES = tuple(t.name for t in GOLD)
# Tables that only grow have no versions.
BOOKS = ("state", "stats", "runs", "rogue_values", "files")
VERSIONS = "version string, written_at timestamp, batch string"


def _new_version() -> str:
    return f"v-{uuid.uuid4().hex}"


class TableNotFound(LookupError):
    """A table is read before any run has written it."""


def by_month(
    df: DataFrame,
    date_column: str = "order_date",
    written: Observation | None = None,
    derive: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Rows laid out for month partitions, sorted by region and category inside each file.

    ``rebalance`` shuffles by month and lets the adaptive planner split a month that holds
    far more rows than the others into several files and merge small ones.  ``written``
    receives the row count (as ``rows``) in the writing stage, where each task counts once.
    ``derive`` makes the derived columns out of the others; with it they are left out of the
    shuffle and the sort and made behind them.
    """
    cluster = [c for c in ("region", "category") if c in df.columns]
    narrow = df.drop(*DERIVED) if derive else df
    laid_out = narrow.withColumn(MONTH, F.trunc(date_column, "month")).hint("rebalance", MONTH)
    if written is not None:
        laid_out = laid_out.observe(written, F.count(F.lit(1)).alias("rows"))
    ordered = laid_out.sortWithinPartitions(MONTH, *cluster)
    return derive(ordered).select(*df.columns, MONTH) if derive else ordered


class Lake:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def folder(self, table: str) -> str:
        return f"{self.root}/gold/{table}" if table in GOLD_NAMES else f"{self.root}/{table}"

    def _rows(self, table: str) -> DataFrame | None:
        pointer = f"{self.root}/versions/{table}"
        return self.spark.read.schema(VERSIONS).parquet(pointer) if path_exists(self.spark, pointer) else None

    def version(self, table: str) -> str | None:
        """The version that holds; None if the table was never replaced."""
        rows = self._rows(table)
        return rows and rows.agg(F.max_by("version", F.struct("written_at", "version")).alias("v")).first()["v"]

    def batches(self, table: str) -> list[str]:
        """The folders the table consists of, in the order they were added; its version leads."""
        rows = self._rows(table)
        if rows is None:
            return []
        version = self.version(table)
        found = rows.where((F.col("version") == version) & F.col("batch").isNotNull()).orderBy("written_at", "batch")
        return [version, *(r["batch"] for r in found.select("batch").collect())]

    def read_batches(self, table: str, batches: list[str]) -> DataFrame:
        """Some of the folders, without looking at the others."""
        return self._read([f"{self.folder(table)}/{b}" for b in batches])

    def _read(self, paths: list[str]) -> DataFrame:
        """All files of some folders in one scan; without the month, which only their names have."""
        if len(paths) == 1:
            return self.spark.read.parquet(*paths).drop(MONTH)
        return self.spark.read.option("recursiveFileLookup", True).parquet(*paths)

    def path(self, table: str) -> str:
        """Where the table's files are: its version, or its folder for append-only ones."""
        if table in BOOKS:
            return self.folder(table)
        version = self.version(table)
        return f"{self.folder(table)}/{version}" if version else self.folder(table)

    def paths(self, table: str) -> list[str]:
        """All folders the table is read from."""
        if table != FACT:
            return [self.path(table)]
        return [f"{self.folder(table)}/{b}" for b in self.batches(table)]

    def find(self, table: str) -> DataFrame | None:
        """The table, or None if it was never written completely."""
        if table not in BOOKS and not self.version(table):
            return None
        paths = self.paths(table)
        if not all(path_exists(self.spark, f"{p}/_SUCCESS") for p in paths):
            return None
        try:
            return self._read(paths)
        except AnalysisException as err:
            # A first load without rows leaves a folder without files.
            if err.getCondition() == "UNABLE_TO_INFER_SCHEMA":
                return None
            raise

    def _switch(self, table: str, version: str, batch: str | None = None) -> None:
        """Make a written version the table, or a written batch part of it.

        Versions before the one it follows go, and batches that never became part of one.
        """
        last = set(self.batches(table)) if table == FACT else {self.version(table)}
        row = self.spark.range(1).select(
            F.lit(version).alias("version"),
            F.current_timestamp().alias("written_at"),
            F.lit(batch).cast("string").alias("batch"),
        )
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/versions/{table}")
        for old in folders_in(self.spark, self.folder(table)):
            if old not in {version, batch, *last} and old.startswith(("v-", "b-")):
                delete_folder(self.spark, f"{self.folder(table)}/{old}")

    def fact_by_month(self) -> DataFrame:
        """The fact with the month of its folders, which an export can keep without a shuffle."""
        self.read(FACT)
        scans = [self.spark.read.parquet(p) for p in self.paths(FACT)]
        scans = [s.withColumn(MONTH, F.col(MONTH).cast("date")) for s in scans]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)

    def fact_since(self, since: date | str | None, buffer_days: int = 0) -> DataFrame:
        """Fact rows on or after a day less the buffer; earlier month folders are not read."""
        if not self.exists(FACT):
            raise TableNotFound(f"{FACT} does not exist under {self.root}; run the load first")
        if since is None:
            return self.read(FACT)
        first = F.date_sub(F.lit(str(since)).cast("date"), buffer_days)
        wanted = (F.col(MONTH) >= F.trunc(first, "month")) & (F.col("order_date") >= first)
        # Each folder has months of its own, so each is a scan that Spark prunes.
        scans = [self.spark.read.parquet(p).filter(wanted).drop(MONTH) for p in self.paths(FACT)]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)

    def exists(self, table: str) -> bool:
        return self.find(table) is not None

    def read(self, table: str) -> DataFrame:
        df = self.find(table)
        if df is None:
            raise TableNotFound(f"{table} does not exist under {self.root}; run the load first")
        return df

    def tables(self) -> list[str]:
        return [t for t in (FACT, *GOLD_NAMES) if self.exists(t)]

    def replace(self, table: str, df: DataFrame) -> None:
        """Full replacement: a new version, and the switch to it last."""
        version = _new_version()
        df.write.option("compression", "snappy").parquet(f"{self.folder(table)}/{version}")
        self._switch(table, version)

    def append(self, table: str, df: DataFrame) -> None:
        """Add rows to a table that is never replaced."""
        df.write.mode("append").option("compression", "snappy").parquet(self.folder(table))

    def write_fact(
        self, df: DataFrame, mode: str, derive: Callable[[DataFrame], DataFrame] | None = None
    ) -> int:
        """Add a batch to the fact or replace it; returns the rows written.

        ``derive`` is what made the batch's derived columns; they are made again, not shuffled.

        A batch that breaks half-way leaves a folder nobody reads, so its repeat sees the fact as
        it was: no key counts as known by a part of it, and no row comes in twice.
        """
        written = Observation("fact")
        version = self.version(FACT) if mode == "append" else None
        target = f"b-{uuid.uuid4().hex}" if version else _new_version()
        (
            by_month(df, written=written, derive=derive)
            .write.option("compression", "zstd")
            .partitionBy(MONTH)
            .parquet(f"{self.folder(FACT)}/{target}")
        )
        rows = written.get["rows"]
        if not version:
            self._switch(FACT, target)
        elif rows:
            self._switch(FACT, version, target)
        return rows

    def columns(self, table: str) -> list[tuple[str, str]]:
        return self.read(table).dtypes

    def row_counts(self) -> DataFrame:
        """(table_name, rows) for the fact and the aggregate tables."""
        return count_tables({t: self.read(t) for t in (FACT, *GOLD_NAMES)})

    def register_views(
        self, header_names: bool = False, schema: SourceSchema = DEFAULT_SCHEMA
    ) -> list[str]:
        """Temp views for ad-hoc SQL: ``fact_sales`` and ``agg_<aggregate table>``.

        ``header_names`` gives source columns the spelling of the files ("Sub-Category").
        """
        views = []
        for table in self.tables():
            df = self.read(table)
            if header_names:
                df = df.toDF(*[schema.header_of(c) for c in df.columns])
            views.append(table if table == FACT else f"agg_{table}")
            df.createOrReplaceTempView(views[-1])
        return views


def count_tables(frames: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rows), one small aggregation per table."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in frames.items()
    ]
    out = counts[0]
    for df in counts[1:]:
        out = out.unionByName(df)
    return out

