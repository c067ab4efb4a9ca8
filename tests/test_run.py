import random
import shutil
from types import SimpleNamespace

import pytest
from conftest import ROWS, make
from pyspark.sql import functions as F

from orderflow.operators.clean import clean
from orderflow.operators.features import engineer
from orderflow.operators.quality import QualityGateError
from orderflow.plans import gold, maintained, run
from orderflow.session import Stage
from orderflow.sources import export, names
from orderflow.sources.bronze import read_bronze, write_csv
from orderflow.sources.lake import FACT, Lake, TableNotFound
from orderflow.streaming.incremental import load_stream, start_load

QUIET = run.Config(make_profile=False, min_rows=1)


def lines(first, count, month=1, day=None):
    """Good raw rows with ids from ``first``, each a day later than the one before."""
    out = []
    for i in range(count):
        row = list(ROWS[i % 5])
        row[0], row[1] = first + i, f"O-{first + i}"
        row[2] = row[3] = f"{month}/{day or (i % 28) + 1}/2017"
        row[8] = row[8] or "10001"
        out.append(tuple(row))
    return out


def batch(spark, ids, day=None):
    return engineer(clean(make(spark, [r for i in ids for r in lines(i, 1, day=day or i)])))


def state(lake):
    return sorted(r["row_id"] for r in lake.read(FACT).select("row_id").collect())


# --- loading -----------------------------------------------------------------------------


def load(spark, lake, stage, *batches, full=False):
    out = None
    for ids in batches:
        rows = batch(spark, ids or [1])
        out = run.load(lake, rows if ids else rows.limit(0), run.Config(), stage, full)
    return out


@pytest.mark.parametrize(
    ("batches", "inserted", "total", "watermark"),
    [
        ([[7]], 1, 1, "2017-01-07"),
        ([[14, 3], [12]], 1, 3, "2017-01-12"),
        ([[5, 6], [6, 5, 6]], 0, 2, "2017-01-06"),
        ([[9, 8, 20], [8, 21, 22], [20, 23]], 1, 6, "2017-01-23"),
        ([[2, 4], []], 0, 2, None),
    ],
)
def test_load_scenarios(spark, stage, tmp_path, batches, inserted, total, watermark):
    lake = Lake(spark, str(tmp_path))
    got = load(spark, lake, stage, *batches)
    assert (got["new_rows_inserted"], got["rows_loaded"], got["watermark_candidate"]) == (inserted, total, watermark)
    assert lake.read("sales_by_region").agg(F.sum("total_rows")).first()[0] == total
    assert lake.tables() == [FACT, *[t.name for t in gold.GOLD]]


def test_full_refresh_replaces(spark, stage, tmp_path):
    lake = Lake(spark, str(tmp_path))
    load(spark, lake, stage, [1, 2, 3])
    got = load(spark, lake, stage, [10, 11], full=True)
    assert got["new_rows_inserted"] == 2 and state(lake) == [10, 11]


def test_any_split_into_overlapping_batches_gives_the_same_tables(spark, stage, tmp_path):
    ids = list(range(1, 25))
    whole = Lake(spark, str(tmp_path / "whole"))
    load(spark, whole, stage, ids)
    rng = random.Random(4)
    cuts = sorted(rng.sample(ids, 2))
    pieces = [ids[: cuts[0] + 2], ids[cuts[0] - 1 : cuts[1] + 3], ids[cuts[1] - 1 :]]
    split = Lake(spark, str(tmp_path / "split"))
    load(spark, split, stage, *pieces)
    for table in whole.tables():
        assert whole.read(table).exceptAll(split.read(table)).isEmpty()
        assert split.read(table).exceptAll(whole.read(table)).isEmpty()


def test_fact_layout_and_missing_tables(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    with pytest.raises(TableNotFound, match="run the load first"):
        lake.read(FACT)
    assert lake.write_fact(batch(spark, [1, 2]), "overwrite") == 2
    assert [p.name for p in (tmp_path / FACT).glob("v-*/order_month_start=*")] == ["order_month_start=2017-01-01"]
    assert "order_month_start" not in lake.read(FACT).columns
    assert dict(lake.columns(FACT))["order_date"] == "date"


def test_reading_since_a_day_skips_month_folders(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    rows = engineer(clean(make(spark, lines(1, 28) + lines(50, 28, month=6))))
    lake.write_fact(rows, "overwrite")
    recent = lake.fact_since("2017-06-10", 3)
    assert recent.count() == 22 and recent.columns == rows.columns
    assert len(recent.inputFiles()) == 2  # of the relation; the scan itself is pruned
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_month_start" in plan
    assert lake.fact_since(None).count() == 56


def test_a_hot_month_is_split_over_files(spark, tmp_path):
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        one = batch(spark, [1])
        hot = one.withColumn("row_id", F.explode(F.sequence(F.lit(1), F.lit(60000)))).repartition(8)
        rows = hot.withColumn("product_name", F.sha2(F.col("row_id").cast("string"), 512))
        assert Lake(spark, str(tmp_path)).write_fact(rows, "overwrite") == 60000
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert len(list((tmp_path / FACT).glob("v-*/*/*.parquet"))) > 1


# --- state of the aggregate tables -----------------------------------------------------------


def same_as_rebuilt(spark, lake):
    fact = lake.read(FACT)
    for name, df in gold.all_tables(fact).items():
        assert sorted(map(tuple, df.collect()), key=str) == sorted(map(tuple, lake.read(name).collect()), key=str)


def test_a_batch_is_merged_without_reading_the_fact(spark, stage, tmp_path, monkeypatch):
    lake = Lake(spark, str(tmp_path))
    load(spark, lake, stage, [1, 2, 3, 4, 5])
    read, real = [], Lake.read_batches
    monkeypatch.setattr(Lake, "read_batches", lambda self, t, b: read.append(b) or real(self, t, b))
    load(spark, lake, stage, [5, 6, 28])
    first, second = lake.batches(FACT)
    assert read == [[second]] and first != second
    same_as_rebuilt(spark, lake)
    # Nothing new: the tables are written from the sums alone.
    load(spark, lake, stage, [6])
    assert read == [[second]]


def test_an_order_seen_again_counts_once(spark, stage, tmp_path):
    lake = Lake(spark, str(tmp_path))
    one = batch(spark, [1, 2, 3, 4])
    again = one.withColumn("row_id", F.col("row_id") + 100)
    holed = one.withColumns({"row_id": F.col("row_id") + 200, "order_id": F.lit(None).cast("string"), "region": F.lit(None).cast("string")})
    for rows in (one, again, holed):
        run.load(lake, rows, run.Config(), stage)
        same_as_rebuilt(spark, lake)
    assert lake.read("monthly_trends").first()["total_orders"] == 4


def test_a_merge_that_breaks_is_done_again_and_only_once(spark, stage, tmp_path, monkeypatch):
    lake = Lake(spark, str(tmp_path))
    load(spark, lake, stage, [1, 2])
    whole = maintained.counted
    monkeypatch.setattr(maintained, "counted", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        load(spark, lake, stage, [3, 4])
    assert state(lake) == [1, 2, 3, 4] and lake.read("sales_by_region").agg(F.sum("total_rows")).first()[0] == 2
    monkeypatch.setattr(maintained, "counted", whole)
    load(spark, lake, stage, [4])
    same_as_rebuilt(spark, lake)
    # A state whose files are lost is built from the fact again.
    shutil.rmtree(tmp_path / "gold_state")
    load(spark, lake, stage, [5])
    same_as_rebuilt(spark, lake)


def test_a_long_chain_is_written_into_one(spark, stage, tmp_path, monkeypatch):
    monkeypatch.setattr(maintained, "LONGEST", 2)
    lake = Lake(spark, str(tmp_path))
    load(spark, lake, stage, [1, 2], [2, 3], [3, 4])
    same_as_rebuilt(spark, lake)
    assert len(list((tmp_path / "gold_state").glob("s-*"))) == 1
    load(spark, lake, stage, [4, 5, 1])
    same_as_rebuilt(spark, lake)


def test_an_append_that_breaks_half_way_can_be_repeated(spark, tmp_path):
    """Keys that repeat inside a batch, and NULL keys, come in once each whatever broke before."""
    lake = Lake(spark, str(tmp_path))
    lake.write_fact(batch(spark, [1]), "overwrite")
    two = batch(spark, [2, 3])
    rows = two.unionByName(two.where("row_id = 2")).withColumn("row_id", F.when(F.col("row_id") != 3, F.col("row_id")))
    broken = rows.withColumn("sales", F.when(F.col("row_id").isNull(), F.raise_error(F.lit("disk full"))).otherwise(F.col("sales")))
    with pytest.raises(Exception, match="disk full"):
        run.load_fact(lake, broken.withColumn("sales", F.col("sales").cast("double")), "row_id")
    # As a job that died after writing some of its files would leave it.
    rows.limit(1).write.parquet(f"{lake.folder(FACT)}/b-half/order_month_start=2017-01-01")
    assert [r["row_id"] for r in lake.read(FACT).collect()] == [1]
    for _ in range(2):
        run.load_fact(lake, rows.where("row_id IS NOT NULL"), "row_id")
    run.load_fact(lake, rows.where("row_id IS NULL"), "row_id")
    assert sorted((r["row_id"] for r in lake.read(FACT).collect()), key=str) == [1, 2, 2, None]
    assert len(lake.batches(FACT)) == 3 and not (tmp_path / FACT / "b-half").exists()
    assert lake.fact_since("2017-01-01").count() == 4


# --- whole runs --------------------------------------------------------------------------


def test_runs_baseline_increment_and_repeat(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "lake")
    write_csv(make(spark, lines(1, 120)), source)
    first = run.run(spark, source, root, run.Config())
    lake = Lake(spark, root)
    assert first["overall_status"] == "success" and first["drift"]["is_first_run"]
    assert [q["total_checks"] for q in first["quality_checks"]] == [5, 6]
    assert first["stages"]["load"]["rows_loaded"] == 120
    assert first["stages"]["profile"]["tables"] == ["columns", "histogram", "correlation", "missing"]
    assert lake.read("profile/columns").count() == 34
    assert str(run.read_watermark(lake)) == "2017-01-28"

    write_csv(make(spark, lines(100000, 10, month=6)), source)
    second = run.run(spark, source, root, QUIET)
    assert second["stages"]["load"]["new_rows_inserted"] == 10
    assert second["stages"]["extract"]["rows_before_filter"] == 130
    assert second["stages"]["extract"]["row_count"] < 40
    assert {f["metric"] for f in second["drift"]["findings"]} == {"row_count"}

    third = run.run(spark, source, root, QUIET)
    assert third["stages"]["load"]["new_rows_inserted"] == 0
    assert third["stages"]["load"]["rows_loaded"] == 130
    assert third["drift"]["findings"] == []

    fresh = run.run(spark, source, root, QUIET, full_refresh=True)
    assert fresh["watermark"]["since"] is None and fresh["stages"]["load"]["new_rows_inserted"] == 130
    assert lake.read("runs").count() == 4 and lake.read("state").count() == 4


def test_late_rows_inside_and_outside_the_buffer(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "lake")
    write_csv(make(spark, lines(1, 28)), source)
    run.run(spark, source, root, QUIET)
    write_csv(make(spark, lines(500, 1, day=25) + lines(600, 1, day=24)), source)
    run.run(spark, source, root, QUIET)
    assert [i for i in state(Lake(spark, root)) if i >= 500] == [500]


def test_failed_gate_stops_before_any_write(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "lake")
    bad = [list(x) for x in lines(1, 5)]
    bad[0][12] = "Overseas"
    write_csv(make(spark, bad), source)
    with pytest.raises(QualityGateError, match="raw"):
        run.run(spark, source, root, QUIET)
    lake = Lake(spark, root)
    assert not lake.exists(FACT) and not lake.exists("state")
    assert [(r["column_name"], r["value"], r["rows"], r["stage"]) for r in lake.read("rogue_values").collect()] == [
        ("region", "Overseas", 1, "raw")
    ]
    assert lake.read("runs").first()["overall_status"] == "failed"
    lenient = run.Config(make_profile=False, min_rows=1, fail_on_quality_error=False)
    assert run.run(spark, source, root, lenient)["stages"]["load"]["rows_loaded"] == 5


def test_duplicates_are_dropped_when_the_gate_is_off(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "lake")
    rows = lines(1, 6)
    write_csv(make(spark, rows + rows[:2]), source)
    config = run.Config(make_profile=False, min_rows=1, fail_on_quality_error=False)
    report = run.run(spark, source, root, config)
    assert report["stages"]["clean"]["rows_dropped"] == 2 and len(state(Lake(spark, root))) == 6


def test_empty_source(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "lake")
    write_csv(make(spark, lines(1, 3)), source)
    run.run(spark, source, root, QUIET)
    run.write_watermark(Lake(spark, root), run.date(2030, 1, 1), "jump")
    report = run.run(spark, source, root, QUIET)
    assert report["stages"]["extract"]["row_count"] == 0
    assert report["watermark"]["new_watermark"] is None
    assert report["stages"]["load"]["rows_loaded"] == 3


def test_a_broken_profile_does_not_stop_a_run(spark, stage, tmp_path, monkeypatch):
    monkeypatch.setattr(run.profile, "profile_missing", lambda df: 1 / 0)
    assert run.write_profile(Lake(spark, str(tmp_path)), batch(spark, [1]), QUIET, stage) is None


def test_views(spark, stage, tmp_path):
    lake = Lake(spark, str(tmp_path))
    load(spark, lake, stage, [1, 2, 3])
    assert "agg_sales_by_region" in lake.register_views()
    assert spark.sql("SELECT sum(total_rows) FROM agg_sales_by_region").first()[0] == 3
    lake.register_views(header_names=True)
    got = spark.sql("SELECT `Sub-Category` FROM fact_sales WHERE `Row ID` = 1").first()[0]
    assert got == "Phones"


def test_stream_form_equals_the_batch_form(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "lake")
    for part in (lines(1, 10), lines(5, 10), lines(200, 3, month=3)):
        write_csv(make(spark, part).coalesce(1), source)
    config = run.Config(make_profile=False, min_rows=1)
    for _ in range(2):
        query = start_load(spark, source, root, str(tmp_path / "cp"), config, max_files=1)
        query.awaitTermination()
        assert query.exception() is None
    assert state(Lake(spark, root)) == [*range(1, 15), 200, 201, 202]
    runs = Lake(spark, root).read("runs").collect()
    assert len(runs) == 3 and {r["overall_status"] for r in runs} == {"success"}
    write_csv(make(spark, lines(300, 2)).coalesce(1), source)
    start_load(spark, source, root, str(tmp_path / "cp"), config).awaitTermination()
    assert len(state(Lake(spark, root))) == 19
    assert Lake(spark, root).read("sales_by_region").agg(F.sum("total_rows")).first()[0] == 19


def test_a_stream_renews_the_tables_once(spark, tmp_path, monkeypatch):
    source, root, rebuilt = str(tmp_path / "in"), str(tmp_path / "lake"), []
    for part in (lines(1, 10), lines(5, 10)):
        write_csv(make(spark, part).coalesce(1), source)
    whole = run.rebuild_gold
    monkeypatch.setattr("orderflow.streaming.incremental.rebuild_gold", lambda *a: (rebuilt.append(1), whole(*a))[1])
    load_stream(spark, source, root, str(tmp_path / "cp"), QUIET, max_files=1)
    lake = Lake(spark, root)
    assert len(rebuilt) == 1 and lake.read("sales_by_region").agg(F.sum("total_rows")).first()[0] == 14
    assert lake.read("runs").count() == 2


# --- export ------------------------------------------------------------------------------


def test_export_and_parity(spark, tmp_path):
    fact = batch(spark, [1, 2, 3])
    frames = {FACT: fact, **gold.all_tables(fact)}
    target = str(tmp_path / "wh")
    for _ in range(2):
        meta = export.export_tables(frames, target)
    assert meta["tables_loaded"] == [
        "fact_sales", "agg_sales_by_region", "agg_sales_by_category",
        "agg_customer_segments", "agg_monthly_trends", "agg_product_performance",
    ]
    parity = export.row_count_parity(spark, frames, target).collect()
    assert len(parity) == 6 and all(r["matches"] for r in parity)
    with pytest.raises(ValueError, match="target"):
        export.export_tables(frames, " ")


def test_names(spark):
    wanted = {"  Net -- Total (EUR) ": "net_total_eur", "Ship.Mode": "ship_mode", "2nd Class": "_2nd_class", "__a__b__": "a__b"}
    assert {n: names.sanitize_name(n) for n in wanted} == wanted
    for nothing in ("", " _ ", "€ %"):
        with pytest.raises(ValueError, match="usable"):
            names.sanitize_name(nothing)
    with pytest.raises(ValueError, match="collide"):
        names.sanitize_columns(spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int"))


def test_stage_is_on_shared_storage(spark, tmp_path):
    """Named by the session, else under the tables, else local and then only for local masters."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    root = Stage(spark).root
    assert root.startswith(folder) if folder else "orderflow-" in root

    class Session:
        def __init__(self, master, folder=None):
            self.conf = {"spark.checkpoint.dir": folder} if folder else {}
            self.sparkContext = SimpleNamespace(master=master, applicationId="app-x")

    assert Stage(Session("yarn", "hdfs://shared/"), "r", "/lake").root == "hdfs://shared/_stage/r"
    assert Stage(Session("yarn"), "r", "/lake").root == "/lake/_stage/r"
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://https://host"):
        with pytest.raises(RuntimeError, match="share"):
            Stage(Session(master), "r")
    assert "orderflow-app-x" in Stage(Session("local[4]"), "r").root


# --- what a broken run leaves ------------------------------------------------------------


def test_a_mark_without_a_fact_is_not_believed(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "lake")
    write_csv(make(spark, lines(1, 40)), source)
    lake = Lake(spark, root)
    run.write_watermark(lake, run.date(2017, 1, 27), "lost")
    assert run.run(spark, source, root, QUIET)["stages"]["load"]["rows_loaded"] == 40
    shutil.rmtree(tmp_path / "lake" / FACT)
    assert run.run(spark, source, root, QUIET)["stages"]["load"]["rows_loaded"] == 40


def test_a_refresh_that_breaks_leaves_the_tables_as_they_were(spark, stage, tmp_path, monkeypatch):
    source, root = str(tmp_path / "in"), str(tmp_path / "lake")
    write_csv(make(spark, lines(1, 30)), source)
    run.run(spark, source, root, QUIET)
    lake = Lake(spark, root)
    broken = batch(spark, [25]).withColumn("sales", F.raise_error(F.lit("disk full")).cast("double"))
    with pytest.raises(Exception, match="disk full"):
        lake.write_fact(broken, "overwrite")
    with pytest.raises(Exception, match="disk full"):
        lake.replace("sales_by_region", broken)
    # A version that was written but never switched to is no table either.
    batch(spark, [26]).write.parquet(f"{lake.folder(FACT)}/v-stray")
    assert state(lake) == list(range(1, 31))
    assert lake.read("sales_by_region").agg(F.sum("total_rows")).first()[0] == 30
    report = run.run(spark, source, root, QUIET)
    assert report["stages"]["load"]["rows_loaded"] == 30
    (tmp_path / "lake" / FACT / lake.version(FACT) / "_SUCCESS").unlink()
    assert not lake.exists(FACT)


def test_old_versions_go_and_readers_of_the_last_one_finish(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    readers = []
    for i in range(4):
        lake.replace("profile/x", spark.range(i))
        readers.append(lake.read("profile/x"))
    assert readers[-2].count() == 2 and lake.read("profile/x").count() == 3
    assert len([p for p in (tmp_path / "profile/x").iterdir() if p.name.startswith("v-")]) == 2


@pytest.mark.parametrize("bad", [float("inf"), float("nan"), 1e19])
def test_a_number_no_sum_can_hold_stops_before_any_write(spark, tmp_path, bad):
    source, root = str(tmp_path / "in"), str(tmp_path / "lake")
    good, rows = lines(1, 20), lines(21, 3, month=2)
    write_csv(make(spark, good), source)
    run.run(spark, source, root, QUIET)
    rows[1] = (*rows[1][:17], bad, *rows[1][18:])
    spoiled = str(tmp_path / "spoiled")
    write_csv(make(spark, good + rows), spoiled)
    with pytest.raises(QualityGateError, match="raw"):
        run.run(spark, spoiled, root, QUIET)
    lake = Lake(spark, root)
    assert state(lake) == list(range(1, 21))
    # Let through on purpose, the value is missing, and later runs go on.
    lenient = run.Config(make_profile=False, min_rows=1, fail_on_quality_error=False)
    for _ in range(2):
        assert run.run(spark, spoiled, root, lenient)["stages"]["load"]["rows_loaded"] == 23
    assert lake.read(FACT).filter("sales IS NULL").count() == 1


def test_the_report_of_a_run_that_fails_twice_does_not_hide_the_first_error(spark, tmp_path, monkeypatch):
    source, root = str(tmp_path / "in"), str(tmp_path / "lake")
    write_csv(make(spark, lines(1, 3)), source)
    monkeypatch.setattr(run, "prepare", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        run.run(spark, source, root, QUIET)
    cleared = []
    monkeypatch.setattr(run.Stage, "clear", lambda self: cleared.append(self.root))
    monkeypatch.setattr(run, "keep_report", lambda *a: [][0])
    with pytest.raises(IndexError) as err:
        run.run(spark, source, root, QUIET)
    assert isinstance(err.value.__context__, ZeroDivisionError) and len(cleared) == 1


def test_read_back_rows_equal_written(spark, tmp_path):
    write_csv(make(spark, lines(1, 3)), str(tmp_path / "x"))
    assert sorted(map(tuple, read_bronze(spark, str(tmp_path / "x")).collect())) == lines(1, 3)
