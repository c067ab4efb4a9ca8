"""The raw CSV edge: columns by header name, missing-value texts, gates, extraction counts."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.functions import na_to_null
from orderflow.operators.clean import DATE_FORMAT
from orderflow.schema import DEFAULT_SCHEMA, TITLE_CASED, SourceSchema
from orderflow.session import Stage, path_exists
from orderflow.sources.files import Reading, SourceNotFound, header_fields, headers, ledger_rows, list_files, literal, plan_reading

# Encoding names as users write them and as Spark accepts them.
_ENCODINGS = {"latin-1": "ISO-8859-1", "latin1": "ISO-8859-1", "utf8": "UTF-8"}
_SURPLUS = "_surplus_fields"
_UNREAD = "_unread_fields"
SOURCE_FILE = "_source_file"
# Columns with few values among very many rows.
REPEATING = {*TITLE_CASED, "order_date", "ship_date", "quantity", "discount", SOURCE_FILE}


def encoding_name(encoding: str) -> str:
    """The name Spark accepts, for the batch reader and the stream alike."""
    return _ENCODINGS.get(encoding.lower(), encoding)


class MissingColumns(ValueError):
    """The source lacks declared columns."""


def read_text(
    spark: SparkSession,
    path: str,
    encoding: str = "latin-1",
    sep: str = ",",
    multi_line: bool = False,
    reading: Reading | None = None,
    keep_file: bool = False,
) -> DataFrame:
    """A CSV file or folder with every column as text, each file bound by its own header.

    Files are grouped by their header line and each group is read by its names, so a folder
    may hold files with other column orders or more columns; what a file lacks is NULL.  A line
    with more fields than its header fails the next action.  ``multi_line`` allows line
    breaks inside quotes, but makes every file a single task.  ``reading`` is a planned list of
    files; without it all are read.  ``keep_file`` adds each row's file.  Encodings have to write ASCII as ASCII.
    """
    charset = encoding_name(encoding)
    planned = reading or plan_reading(spark, path, charset)
    groups = planned.groups(sep).items()
    frames = [_read_group(spark, files, list(header), charset, sep, multi_line) for header, files in groups]
    if not frames:
        return spark.createDataFrame([], T.StructType())
    # The widest header leads, so that the common columns keep the order most files have.
    frames.sort(key=lambda f: -len(f.columns))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return rows if keep_file else rows.drop(SOURCE_FILE)


def _read_group(
    spark: SparkSession, files: list[str], header: list[str], charset: str, sep: str, multi_line: bool
) -> DataFrame:
    """Files of one header.  A column behind the last one shows where a line has more fields.

    The one behind that is declared and never read: where columns are picked, Spark's parser fills up a
    line that lacks some, and does not take each line without surplus fields for a malformed one.
    """
    repeated = sorted({c for c in header if header.count(c) > 1 or c in (_SURPLUS, _UNREAD, SOURCE_FILE)})
    if repeated:
        raise ValueError(f"a header names columns twice, or as this reader names its own: {repeated}")
    fields = [T.StructField(c, T.StringType()) for c in [*header, _SURPLUS, _UNREAD]]
    rows = (
        spark.read.schema(T.StructType(fields))
        .option("header", True)
        .option("encoding", charset)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", True)
        .option("multiLine", multi_line)
        .csv([literal(f) for f in files])
    )
    told = F.concat(F.lit("a line has more fields than its header; the first too many is: "), F.col(_SURPLUS))
    return rows.filter(F.when(F.col(_SURPLUS).isNull(), True).otherwise(F.raise_error(told).cast("boolean"))).select(
        *[F.col(f"`{c}`") for c in header], F.col("_metadata.file_path").alias(SOURCE_FILE)
    )


def check_columns(df: DataFrame, schema: SourceSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Raise before any job if a declared column is missing; extra columns are fine."""
    missing = sorted(r.header for r in schema.rules if r.header not in df.columns)
    if missing:
        raise MissingColumns(f"missing columns: {missing}")
    return df


def apply_schema(df: DataFrame, schema: SourceSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Declared columns first, renamed and typed; extra columns follow as text.

    A text that is no number in a number column fails the next action.
    """
    declared = [
        na_to_null(F.col(f"`{r.header}`")).cast(r.raw_type).alias(r.name) for r in schema.rules
    ]
    headers = {r.header for r in schema.rules}
    extra = [na_to_null(F.col(f"`{c}`")).alias(c) for c in df.columns if c not in headers]
    return df.select(*declared, *extra)


def read_bronze(
    spark: SparkSession, path: str, schema: SourceSchema = DEFAULT_SCHEMA, **options
) -> DataFrame:
    """Raw order lines: existence and column gates passed, numbers typed, dates still text."""
    raw = check_columns(read_text(spark, path, **options), schema)
    return apply_schema(raw, schema)


def since_predicate(
    order_date: Column, since: date | str | None, buffer_days: int, date_format: str | None
) -> Column:
    """True for rows on or after ``since`` less the re-check buffer; for all without one."""
    if since is None:
        return F.lit(True)
    day = F.to_date(order_date, date_format) if date_format else order_date
    return day >= F.date_sub(F.lit(str(since)).cast("date"), buffer_days)


def since_watermark(
    df: DataFrame,
    since: date | str | None,
    buffer_days: int = 3,
    date_format: str | None = None,
    column: str = "order_date",
) -> DataFrame:
    """Keep what the incremental load has to look at; the date column keeps its type."""
    return df.filter(since_predicate(F.col(column), since, buffer_days, date_format))


@dataclass
class Extraction:
    """A filtered raw batch and the counts its first action fills in."""

    frame: DataFrame
    source_path: str
    since: str | None
    _counts: Observation

    def metadata(self) -> dict:
        """Row and column counts; call it after the first action on ``frame``."""
        counts = self._counts.get
        return {
            "source_path": self.source_path,
            "row_count": counts["row_count"],
            "column_count": len(self.frame.columns),
            "columns": self.frame.columns,
            "since": self.since,
            "rows_before_filter": counts["rows_before_filter"],
        }


def extract(
    spark: SparkSession,
    path: str,
    since: date | str | None = None,
    buffer_days: int = 3,
    schema: SourceSchema = DEFAULT_SCHEMA,
    date_format: str = DATE_FORMAT,
    **options,
) -> Extraction:
    """The raw batch to load.  Both counts are observed on the one pass over the files."""
    raw = read_bronze(spark, path, schema, **options)
    keep = since_predicate(F.col("order_date"), since, buffer_days, date_format)
    counts = Observation("extract")
    observed = raw.observe(
        counts,
        F.count(F.lit(1)).alias("rows_before_filter"),
        F.count_if(keep).alias("row_count"),
    )
    return Extraction(observed.filter(keep), path, None if since is None else str(since), counts)


@dataclass
class Batch:
    """A staged batch of the files that had to be read, and its counts."""

    frame: DataFrame
    counts: dict

    def metadata(self) -> dict:
        return self.counts


def extract_unread(
    stage: Stage,
    path: str,
    ledger: DataFrame | None = None,
    since: date | str | None = None,
    buffer_days: int = 3,
    schema: SourceSchema = DEFAULT_SCHEMA,
    date_format: str = DATE_FORMAT,
    encoding: str = "latin-1",
    run_id: str = "",
    **options,
) -> tuple[Batch, DataFrame]:
    """The raw batch to load, out of the files that can hold some of it, and their ledger rows.

    Files the ledger rules out are not opened.  All rows of the others are staged once, each
    with its file; counts and newest dates per file come from two of the staged columns.
    """
    spark = stage.spark
    reading = plan_reading(spark, path, encoding_name(encoding), ledger, since, buffer_days)
    if not reading.header_of and reading.skipped:
        raw = spark.createDataFrame([], T.StructType([T.StructField(r.header, T.StringType()) for r in schema.rules]))
        raw = raw.withColumn(SOURCE_FILE, F.lit(None).cast("string"))
    else:
        raw = read_text(spark, path, encoding, reading=reading, keep_file=True, **options)
    typed = apply_schema(check_columns(raw, schema), schema)
    day = F.try_to_date("order_date", date_format) if date_format else F.col("order_date")
    # A dictionary of texts that hardly repeat is built for nothing.
    repeating = [c for c in typed.columns if c in REPEATING]
    read = stage.put("read", typed, **{"parquet.enable.dictionary": "false"}, **{f"parquet.enable.dictionary#{c}": "true" for c in repeating})
    keep = since_predicate(F.col("order_date"), since, buffer_days, date_format)
    # A file the tasks found nothing in has no row here and none to load.
    per_file = stage.put(
        "per_file",
        read.groupBy(F.col(SOURCE_FILE).alias("file")).agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(keep).alias("kept"), F.max(day).alias("newest")
        ),
    )
    rows, kept = per_file.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("kept"), F.lit(0))).first()
    frame = (read if since is None else read.filter(keep)).drop(SOURCE_FILE)
    counts = {
        "source_path": path,
        "row_count": kept,
        "column_count": len(frame.columns),
        "columns": frame.columns,
        "since": None if since is None else str(since),
        "rows_before_filter": rows + reading.rows_skipped,
        "files_opened": len(reading.files),
        "files_skipped": reading.skipped,
    }
    return Batch(frame, counts), ledger_rows(spark, reading, per_file.drop("kept"), run_id)


def write_csv(
    df: DataFrame,
    path: str,
    schema: SourceSchema = DEFAULT_SCHEMA,
    mode: str = "append",
    sep: str = ",",
    encoding: str = "latin-1",
    compression: str = "none",
    rows_per_file: int = 0,
) -> None:
    """Write rows under the header names of the source files.

    An append follows the column order of the files that are there; columns of theirs that
    the schema does not know stay empty.  A first write is in the schema's order.  A file with
    ``compression`` is read by one task, so ``rows_per_file`` bounds it; 0 is no bound.
    """
    spark, charset = df.sparkSession, encoding_name(encoding)
    by_header = {r.header: F.col(r.name).alias(r.header) for r in schema.rules}
    order = list(by_header)
    if mode == "append" and path_exists(spark, path):
        first = list_files(spark, path).orderBy("path").first()
        begins = first and headers(spark, [literal(first["path"])], charset).first()
        if begins:
            found = header_fields(begins["header"], sep)
            order = [*found, *(h for h in order if h not in found)]
    nothing = F.lit(None).cast("string")
    (
        df.select(*[by_header.get(h, nothing.alias(h)) for h in order])
        .write.mode(mode)
        .option("header", True)
        .option("encoding", charset)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("compression", compression)
        .option("maxRecordsPerFile", rows_per_file)
        .csv(path)
    )
