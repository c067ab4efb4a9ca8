"""The same insert-only load, fed by new files of a folder instead of a date filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from orderflow.plans.run import Config, Report, keep_report, load, load_fact, prepare, rebuild_gold
from orderflow.session import Stage
from orderflow.sources.bronze import apply_schema, check_columns, encoding_name, read_text
from orderflow.sources.lake import FACT, Lake


def start_load(
    spark: SparkSession,
    source: str,
    root: str,
    checkpoint: str,
    config: Config = Config(),
    max_files: int | None = None,
    rebuild_each: bool = True,
) -> StreamingQuery:
    """Load every file of ``source`` not loaded yet, then stop (``availableNow``).

    ``rebuild_each`` renews the aggregate tables after every micro-batch; load_stream does it
    once for all of them.  Every micro-batch keeps its report in
    ``runs``.  All files must have the column order of the first one: another header stops the
    stream, and fields beyond the header are dropped unseen, unlike in a batch run.  The
    stream's checkpoint takes the place of the high-water mark.  A micro-batch that is run again
    after a failure adds nothing, as its keys are known by then; that is also why no event-time
    watermark is used, which would drop late lines unseen.
    """
    header = check_columns(read_text(spark, source, config.encoding, config.sep), config.schema)
    reader = (
        spark.readStream.schema(header.schema)
        .option("header", True)
        .option("encoding", encoding_name(config.encoding))
        .option("multiLine", config.multi_line)
        .option("sep", config.sep)
        .option("escape", '"')
        .option("enforceSchema", False)
    )
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lake = Lake(spark, root)

    def load_batch(rows: DataFrame, batch_id: int) -> None:
        stage, report = Stage(rows.sparkSession, root=root), Report(f"batch-{batch_id}")
        try:
            raw = report.timed("extract", lambda: stage.put("raw", apply_schema(rows, config.schema)))
            batch = prepare(raw, config, stage, report, lake)
            report.data["stages"]["load"] = report.timed("load", lambda: _load(lake, batch, config, stage, rebuild_each))
            report.finish("success")
        except Exception:
            report.finish("failed")
            raise
        finally:
            try:
                keep_report(lake, report.data)
            finally:
                stage.clear()

    return (
        reader.csv(source)
        .writeStream.foreachBatch(load_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _load(lake: Lake, batch: DataFrame, config: Config, stage: Stage, rebuild: bool) -> dict:
    if rebuild:
        return load(lake, batch, config, stage)
    return {"new_rows_inserted": load_fact(lake, batch, config.schema.key)}


def load_stream(
    spark: SparkSession, source: str, root: str, checkpoint: str, config: Config = Config(), max_files: int | None = None
) -> list[str]:
    """Load all new files, wait, and renew the aggregate tables once."""
    query = start_load(spark, source, root, checkpoint, config, max_files, rebuild_each=False)
    query.awaitTermination()
    lake, stage = Lake(spark, root), Stage(spark, root=root)
    try:
        return rebuild_gold(lake, lake.read(FACT), config.schema.key, stage) if lake.exists(FACT) else []
    finally:
        stage.clear()
