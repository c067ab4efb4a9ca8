"""The end-to-end run: extract, check, clean, check, derive, load, compare, profile."""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime, timezone
from functools import cache, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.operators import drift, incremental, profile, quality
from orderflow.operators.clean import DATE_FORMAT, cast_numerics, normalise, normalise_text
from orderflow.operators.dedup import drop_full_duplicates, has_repeated_fingerprint
from orderflow.operators.features import engineer
from orderflow.plans import gold, maintained
from orderflow.schema import DEFAULT_SCHEMA, DERIVED, SourceSchema
from orderflow.session import Stage, concurrently
from orderflow.sources.bronze import extract_unread
from orderflow.sources.lake import FACT, Lake

log = logging.getLogger("orderflow")

DATED = ("order_date", "ship_date")


@dataclass(frozen=True)
class Config:
    """Settings of a run."""

    schema: SourceSchema = field(default=DEFAULT_SCHEMA)
    encoding: str = "latin-1"
    sep: str = ","
    multi_line: bool = False
    date_format: str = DATE_FORMAT
    fail_on_quality_error: bool = True
    min_rows: int = 100
    buffer_days: int = 3
    drift_threshold: float = 0.05
    make_profile: bool = True
    approximate: bool = False


class Report:
    """What a run did, and how long the jobs of each stage took."""

    def __init__(self, run_id: str):
        self.data = {
            "run_id": run_id,
            "run_timestamp": datetime.now(timezone.utc).isoformat(),
            "stages": {},
            "seconds": {},
            "quality_checks": [],
            "overall_status": "running",
        }
        self._start = time.perf_counter()

    def timed(self, stage: str, work: Callable):
        """Run a stage's actions, log and time them; errors pass through."""
        log.info("stage starting: %s", stage)
        start = time.perf_counter()
        try:
            result = work()
        except Exception:
            log.error("stage failed: %s after %.3f s", stage, time.perf_counter() - start)
            raise
        self.data["seconds"][stage] = round(time.perf_counter() - start, 3)
        log.info("stage complete: %s in %.3f s", stage, self.data["seconds"][stage])
        return result

    def finish(self, status: str) -> dict:
        self.data["overall_status"] = status
        self.data["elapsed_seconds"] = round(time.perf_counter() - self._start, 3)
        return self.data


# --- state -------------------------------------------------------------------------------


def read_watermark(lake: Lake) -> date | None:
    """The current high-water mark, or None before the first successful load."""
    state = lake.find("state")
    if state is None:
        return None
    return state.agg(F.max_by("last_watermark", "updated_at").alias("w")).first()["w"]


def write_watermark(lake: Lake, watermark: date, run_id: str) -> None:
    """Add a state row; the newest row is the current state."""
    row = lake.spark.range(1).select(
        F.lit(watermark).cast("date").alias("last_watermark"),
        F.lit(run_id).alias("last_run_id"),
        F.current_timestamp().alias("updated_at"),
    )
    lake.append("state", row)


# --- stages ------------------------------------------------------------------------------


def keys_differ(raw: DataFrame, schema: SourceSchema) -> bool:
    """Whether no two lines have one key once it is cleaned.

    Then no two are alike, neither as they are nor at any step of cleaning, and only a hash of
    one column was shuffled to prove it.  False says nothing.
    """
    if schema.key not in raw.columns or schema.key in DATED:
        return False
    return not has_repeated_fingerprint(cast_numerics(normalise_text(raw.select(schema.key)), schema))


def prepare(raw: DataFrame, config: Config, stage: Stage, report: Report, lake: Lake) -> DataFrame:
    """Gate the staged raw batch, clean and gate it again, and add the derived columns.

    Every unexpected value of a batch goes to the table ``rogue_values`` before the gate.
    """
    data = report.data
    proven = cache(lambda: keys_differ(raw, config.schema))

    def gate(df: DataFrame, name: str, date_checks: bool) -> None:
        outcome = quality.judge(quality.checked(df, config.schema, date_checks, proven), name, fail_on_error=False)
        data["quality_checks"].append(outcome)
        if not all(c["passed"] for c in outcome["checks"] if c["check_name"] == "allowed_values"):
            rules = [r for r in config.schema.rules if r.name in df.columns]
            stamp = {"run_id": F.lit(data["run_id"]), "stage": F.lit(name)}
            lake.append("rogue_values", quality.rogue_values(df, rules).drop("position").withColumns(stamp))
        if not outcome["passed"] and config.fail_on_quality_error:
            failed = [c["check_name"] for c in outcome["checks"] if not c["passed"]]
            raise quality.QualityGateError(f"quality gate failed on {name} data: {failed}")

    def cleaned_batch() -> DataFrame:
        # The text work is done once and kept.  Proving that nothing repeats is far cheaper
        # than the full-row shuffle; only a batch that may hold duplicates pays for that.
        rows = stage.put("normalised", normalise(raw, config.date_format))
        if not proven() and has_repeated_fingerprint(rows):
            rows = stage.put("deduplicated", drop_full_duplicates(rows))
        return cast_numerics(rows, config.schema)

    report.timed("quality_raw", lambda: gate(raw, "raw", False))
    cleaned = report.timed("clean", cleaned_batch)
    rows_in, rows_out = raw.count(), cleaned.count()
    data["stages"]["clean"] = {
        "rows_input": rows_in,
        "rows_output": rows_out,
        "rows_dropped": rows_in - rows_out,
        "below_min_rows": rows_out < config.min_rows,
        "dtypes": dict(cleaned.dtypes),
    }
    if rows_out < config.min_rows:
        log.warning("only %d rows after cleaning, expected at least %d", rows_out, config.min_rows)
    # Casting can make rows equal that differed as text, so this is counted again.
    report.timed("quality_cleaned", lambda: gate(cleaned, "cleaned", True))
    data["stages"]["engineer"] = {"rows": rows_out, "new_features": sorted(DERIVED)}
    return engineer(cleaned)


def load_fact(
    lake: Lake,
    batch: DataFrame,
    key: str,
    full_refresh: bool = False,
    derive: Callable[[DataFrame], DataFrame] | None = None,
) -> int:
    """Replace the fact (first load, full refresh) or append the batch's new rows to it.

    ``derive`` tells how the batch's derived columns were made, so that no shuffle carries them.
    """
    fact = lake.find(FACT)
    if full_refresh or fact is None:
        return lake.write_fact(batch, "overwrite", derive)
    if batch.isEmpty():
        return 0
    small = incremental.fits_broadcast(batch, key)
    fresh = incremental.new_rows(batch, fact, key, broadcast_keys=small)
    return lake.write_fact(incremental.align_by_name(fresh, fact), "append", derive)


def rebuild_gold(lake: Lake, fact: DataFrame, key: str, stage: Stage) -> list[str]:
    """All five aggregate tables, kept up from their state; ``fact`` stands in for one without rows."""
    if lake.exists(FACT):
        return maintained.renew(lake, stage, key)
    tables = gold.all_tables(fact, key=key)
    concurrently(lake.spark, *[partial(lake.replace, name, df) for name, df in tables.items()])
    return list(tables)


def load(
    lake: Lake,
    batch: DataFrame,
    config: Config,
    stage: Stage,
    full_refresh: bool = False,
    derive: Callable[[DataFrame], DataFrame] | None = None,
) -> dict:
    """Fact first, then the aggregate tables, of everything ever loaded, from their state and the batch."""
    key = config.schema.key
    inserted = load_fact(lake, batch, key, full_refresh, derive)
    fact = lake.find(FACT)
    fact = batch.limit(0) if fact is None else fact
    names, newest, rows = concurrently(
        lake.spark,
        lambda: rebuild_gold(lake, fact, key, stage),
        lambda: incremental.watermark_candidate(batch).first()["watermark"],
        fact.count,
    )
    return {
        "gold_tables": names,
        "rows_loaded": rows,
        "new_rows_inserted": inserted,
        "watermark_candidate": newest,
    }


def compare(lake: Lake, fact: DataFrame, config: Config, run_id: str) -> dict:
    """Drift against the previous run; this run's statistics become the next reference."""
    history = lake.find("stats")
    current = maintained.statistics(lake)
    if current is None:
        current = drift.drift_stats(fact, config.approximate)
    stamped = current.withColumns(
        {"run_id": F.lit(run_id), "computed_at": F.current_timestamp()}
    )
    findings: list[dict] = []
    if history is None:
        lake.append("stats", stamped)
    else:
        last = history.agg(F.max_by("run_id", "computed_at").alias("r")).first()["r"]
        lake.append("stats", stamped)
        stats = lake.read("stats")
        found = drift.drift_findings(
            stats.filter(F.col("run_id") == run_id),
            stats.filter(F.col("run_id") == last),
            config.drift_threshold,
        )
        findings = [row.asDict() for row in found.orderBy("metric").collect()]
        for f in findings:
            log.warning("drift: %s moved by %s %%", f["metric"], f["relative_delta_pct"])
    return {
        "is_first_run": history is None,
        "findings_count": len(findings),
        "findings": findings,
    }


def write_profile(lake: Lake, fact: DataFrame, config: Config, stage: Stage) -> list[str] | None:
    """Profile tables under ``profile/``.  A failure here is logged and never stops a run."""
    try:
        # Sketches need no staged value counts, and bins can be counted without them.
        counts = None if config.approximate else profile.stage_counts(fact, stage)
        tables = {
            "columns": profile.profile_columns(fact, stage, config.approximate, counts),
            "histogram": profile.profile_histogram(fact, counts=counts),
            "correlation": profile.profile_correlation(fact),
            "missing": profile.profile_missing(fact),
        }
        concurrently(lake.spark, *[partial(lake.replace, f"profile/{n}", df) for n, df in tables.items()])
        return list(tables)
    except Exception:
        log.exception("profiling failed; the run goes on")
        return None


# --- run ---------------------------------------------------------------------------------


def run(
    spark: SparkSession,
    source: str,
    root: str,
    config: Config = Config(),
    full_refresh: bool = False,
) -> dict:
    """Load what is new in ``source`` into the tables under ``root`` and report on it.

    The order of writes makes a broken run safe to repeat: fact, aggregate tables, then
    the high-water mark.  Rows a broken run has appended are known keys to the next one, a
    replacement that broke never became the table, and a mark without a complete fact is not
    believed: everything is read again.
    """
    run_id = uuid.uuid4().hex
    lake, stage, report = Lake(spark, root), Stage(spark, run_id, root), Report(run_id)
    data = report.data
    try:
        since = None if full_refresh or not lake.exists(FACT) else read_watermark(lake)

        def extract_batch() -> DataFrame:
            batch, read = extract_unread(
                stage,
                source,
                lake.find("files"),
                since,
                config.buffer_days,
                config.schema,
                config.date_format,
                run_id=run_id,
                encoding=config.encoding,
                sep=config.sep,
                multi_line=config.multi_line,
            )
            # What a file holds is true whether the load succeeds or not; the mark decides.
            lake.append("files", read)
            data["stages"]["extract"] = batch.metadata()
            return batch.frame

        raw = report.timed("extract", extract_batch)
        batch = prepare(raw, config, stage, report, lake)
        loaded = report.timed("load", lambda: load(lake, batch, config, stage, full_refresh, engineer))
        data["stages"]["load"] = loaded

        newest = loaded["watermark_candidate"]
        mark = incremental.later(since, date.fromisoformat(newest) if newest else None)
        if newest:
            write_watermark(lake, mark, run_id)
        data["watermark"] = {
            "since": since.isoformat() if since else None,
            "new_watermark": mark.isoformat() if newest else None,
        }

        fact = lake.find(FACT)
        fact = batch.limit(0) if fact is None else fact
        watch = [lambda: report.timed("drift", lambda: compare(lake, fact, config, run_id))]
        if config.make_profile:
            watch.append(
                lambda: report.timed("profile", lambda: write_profile(lake, fact, config, stage))
            )
        data["drift"], *profiled = concurrently(spark, *watch)
        if profiled:
            data["stages"]["profile"] = {"tables": profiled[0]}
        return report.finish("success")
    except Exception:
        report.finish("failed")
        raise
    finally:
        try:
            keep_report(lake, data)
        finally:
            stage.clear()


def keep_report(lake: Lake, data: dict) -> None:
    row = [(data["run_id"], data["run_timestamp"], data["overall_status"], json.dumps(data, default=str))]
    lake.append(
        "runs",
        lake.spark.createDataFrame(
            row, "run_id string, run_timestamp string, overall_status string, report string"
        ),
    )
