import datetime as dt
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from conftest import ROWS, make

from orderflow.operators import incremental as inc
from orderflow.operators import rows as r
from orderflow.schema import DEFAULT_SCHEMA
from orderflow.session import Stage
from orderflow.sources import bronze
from orderflow.sources.files import headers
from orderflow.sources.lake import Lake

HEADERS = [rule.header for rule in DEFAULT_SCHEMA.rules]


def line(row, order):
    return ",".join("" if row[i] is None else str(row[i]) for i in order)


def csv(path, rows=ROWS, order=None, encoding="latin-1", extra=""):
    order = list(range(len(HEADERS))) if order is None else order
    text = [",".join(HEADERS[i] for i in order) + (",Note" if extra else "")]
    text += [line(row, order) + (f",{extra}" if extra else "") for row in rows]
    path.write_text("\n".join(text) + "\n", encoding=encoding)
    return str(path)


def test_columns_bind_by_header_not_position(spark, tmp_path):
    order = list(reversed(range(len(HEADERS))))
    df = bronze.read_bronze(spark, csv(tmp_path / "a.csv", order=order))
    assert df.columns == DEFAULT_SCHEMA.names
    assert [tuple(x) for x in df.orderBy("row_id").collect()] == ROWS


def test_every_file_is_bound_by_its_own_header(spark, tmp_path):
    csv(tmp_path / "a.csv")
    csv(tmp_path / "b.csv", order=list(reversed(range(len(HEADERS)))))
    csv(tmp_path / "c.csv", extra="more")
    (tmp_path / "d.csv").write_text("")
    got = bronze.read_bronze(spark, str(tmp_path)).collect()
    assert sorted(tuple(x)[:21] for x in got) == sorted(ROWS * 3)
    assert [x["Note"] for x in got].count("more") == 5


def test_a_line_with_more_fields_than_its_header_fails(spark, tmp_path):
    path = csv(tmp_path / "a.csv")
    with open(path, "a") as out:
        out.write(line(ROWS[0], range(len(HEADERS))) + ",one,two\n")
    with pytest.raises(Exception, match="more fields than its header"):
        bronze.read_bronze(spark, path).collect()


def test_fewer_fields_are_null(spark, tmp_path):
    path = csv(tmp_path / "a.csv", order=[0, 1, 17], rows=ROWS[:1])
    with open(path, "a") as out:
        out.write("2,T-1\n")
    assert [tuple(x) for x in bronze.read_text(spark, path).collect()] == [("1", "T-7001", "899.5"), ("2", "T-1", None)]


def test_no_whole_line_is_taken_for_malformed(spark, tmp_path):
    """Spark's parser does so, at the cost of two exceptions, where a reading asks for all that is declared."""
    plan = bronze.read_text(spark, csv(tmp_path / "a.csv"))._jdf.queryExecution()
    declared, read = plan.analyzed().toString(), plan.executedPlan().toString()
    assert "_surplus_fields" in read and "_unread_fields" not in read and "_unread_fields" in declared


def test_staged_texts_that_hardly_repeat_get_no_dictionary(spark, stage, tmp_path):
    bronze.extract_unread(stage, csv(tmp_path / "a.csv"))
    file = next(f for f in Path(stage.path("read")).iterdir() if f.suffix == ".parquet")
    group = pq.ParquetFile(file).metadata.row_group(0)
    coded = {c.path_in_schema for c in map(group.column, range(group.num_columns)) if any("DICTIONARY" in e for e in c.encodings)}
    assert {"region", "order_date", bronze.SOURCE_FILE} <= coded and not coded & {"row_id", "product_name", "sales"}


def test_an_append_follows_the_order_that_is_there(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    csv(folder / "a.csv", order=list(reversed(range(len(HEADERS)))), extra="kept")
    bronze.write_csv(make(spark, [(9, *ROWS[0][1:])]).coalesce(1), str(folder))
    written = next(f for f in folder.iterdir() if f.name.startswith("part-"))
    assert written.read_text().splitlines()[0].split(",") == [*reversed(HEADERS), "Note"]
    assert sorted(x["row_id"] for x in bronze.read_bronze(spark, str(folder)).collect()) == [1, 2, 3, 4, 5, 9]


def test_line_breaks_inside_quotes(spark, tmp_path):
    rows = [list(x) for x in ROWS]
    rows[1][16] = '"Lined\nPad"'
    df = bronze.read_bronze(spark, csv(tmp_path / "a.csv", rows), multi_line=True)
    assert df.filter("row_id = 2").first()["product_name"] == "Lined\nPad"


@pytest.mark.parametrize("name", ["latin1", "LATIN-1", "utf8", "UTF-8"])
def test_encoding_names(spark, tmp_path, name):
    rows = [list(x) for x in ROWS]
    rows[0][9] = "Orléans"
    path = csv(tmp_path / "a.csv", rows, encoding=name)
    assert bronze.read_bronze(spark, path, encoding=name).filter("row_id = 1").first()["city"] == "Orléans"


def test_latin1_and_na_tokens_and_quotes(spark, tmp_path):
    rows = [list(x) for x in ROWS]
    rows[0][9] = "Münster"
    rows[1][9] = "N/A"
    rows[2][16] = '"Chair, 3"" wide"'
    df = bronze.read_bronze(spark, csv(tmp_path / "a.csv", rows))
    got = df.orderBy("row_id").collect()
    assert (got[0]["city"], got[1]["city"], got[2]["product_name"]) == ("Münster", None, 'Chair, 3" wide')


def test_missing_file_and_columns(spark, tmp_path):
    with pytest.raises(bronze.SourceNotFound, match="nowhere"):
        bronze.read_bronze(spark, str(tmp_path / "nowhere.csv"))
    keep = [i for i, h in enumerate(HEADERS) if h not in ("City", "Ship Date", "Discount")]
    with pytest.raises(bronze.MissingColumns, match=r"\['City', 'Discount', 'Ship Date'\]"):
        bronze.read_bronze(spark, csv(tmp_path / "a.csv", order=keep))


def test_extra_columns_flow_through(spark, tmp_path):
    df = bronze.read_bronze(spark, csv(tmp_path / "a.csv", extra="hello"))
    assert df.columns[-1] == "Note" and df.first()["Note"] == "hello"


def test_bad_number_raises(spark, tmp_path):
    rows = [list(x) for x in ROWS]
    rows[0][17] = "cheap"
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        bronze.read_bronze(spark, csv(tmp_path / "a.csv", rows)).collect()


@pytest.mark.parametrize(("since", "kept"), [(None, 5), ("2016-10-05", 3), ("2016-10-06", 2), ("2040-06-30", 0)])
def test_since_with_buffer(spark, tmp_path, since, kept):
    batch = bronze.extract(spark, csv(tmp_path / "a.csv"), since, buffer_days=3)
    assert batch.frame.schema["order_date"].dataType.simpleString() == "string"
    assert len(batch.frame.collect()) == kept
    meta = batch.metadata()
    assert (meta["rows_before_filter"], meta["row_count"], meta["column_count"]) == (5, kept, 21)
    assert meta["since"] == since


def dated(rows, day):
    return [(*r[:2], day, day, *r[4:]) for r in rows]


def unread(spark, stage, lake, path, since, name):
    """A reading with the ledger, as a run does it."""
    batch, read = bronze.extract_unread(Stage(spark, f"{stage.root}/{name}"), str(path), lake.find("files"), since, 3, run_id=name)
    lake.append("files", read)
    return batch


def test_a_repeat_opens_only_files_that_reach_the_mark(spark, stage, tmp_path):
    source, lake = tmp_path / "in", Lake(spark, str(tmp_path / "lake"))
    source.mkdir()
    csv(source / "old [1].csv", dated(ROWS, "1/5/2015"))
    csv(source / "late.csv", dated(ROWS, "6/1/2017"), order=list(reversed(range(len(HEADERS)))))
    csv(source / "undated.csv", dated(ROWS[:2], None))
    (source / "blank.csv").write_text("\n")
    first = unread(spark, stage, lake, source, None, "a")
    assert (first.counts["row_count"], first.counts["files_opened"], first.counts["files_skipped"]) == (12, 4, 0)
    csv(source / "new.csv", dated(ROWS[:3], "6/4/2017"))
    again = unread(spark, stage, lake, source, "2017-06-03", "b")
    assert (again.counts["row_count"], again.counts["rows_before_filter"]) == (8, 15)
    assert (again.counts["files_opened"], again.counts["files_skipped"]) == (2, 3)
    assert sorted(r["order_date"] for r in again.frame.collect()) == ["6/1/2017"] * 5 + ["6/4/2017"] * 3
    opened = {r["file"].rsplit("/", 1)[-1] for r in lake.read("files").where("run_id = 'b'").collect()}
    assert opened == {"late.csv", "new.csv"}
    # Nothing reaches this mark: no file is opened, and the batch is empty with its columns.
    none = unread(spark, stage, lake, source, "2020-01-01", "c")
    assert (none.frame.columns, none.frame.count(), none.counts["files_opened"]) == (DEFAULT_SCHEMA.names, 0, 0)
    assert none.counts["rows_before_filter"] == 15


def test_a_file_that_changed_is_read_again(spark, stage, tmp_path):
    source, lake = tmp_path / "in", Lake(spark, str(tmp_path / "lake"))
    source.mkdir()
    csv(source / "a.csv", dated(ROWS, "1/5/2015"))
    unread(spark, stage, lake, source, None, "a")
    csv(source / "a.csv", dated(ROWS, "1/5/2015") + dated([(9, *ROWS[0][1:])], "6/4/2017"))
    again = unread(spark, stage, lake, source, "2017-06-03", "b")
    assert [r["row_id"] for r in again.frame.collect()] == [9] and again.counts["files_opened"] == 1


def test_headers_are_read_by_tasks(spark, tmp_path):
    csv(tmp_path / "a.csv")
    (tmp_path / "b.csv").write_text("\n  \nRow ID,Nöte\n1,x\n", encoding="latin-1")
    found = {r["file"].rsplit("/", 1)[-1]: r["header"] for r in headers(spark, [str(tmp_path)], "ISO-8859-1").collect()}
    assert found == {"a.csv": ",".join(HEADERS), "b.csv": "Row ID,Nöte"}


def test_own_names_in_a_header_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Row ID,_source_file\n1,x\n")
    with pytest.raises(ValueError, match="_source_file"):
        bronze.read_text(spark, str(tmp_path / "a.csv"))


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    bronze.write_csv(make(spark, ROWS), path)
    bronze.write_csv(make(spark, [(9, *ROWS[0][1:])]), path)
    got = [tuple(x) for x in bronze.read_bronze(spark, path).orderBy("row_id").collect()]
    assert got == [*ROWS, (9, *ROWS[0][1:])]


# --- new rows ----------------------------------------------------------------------------


def keyed(spark, pairs):
    return spark.createDataFrame(pairs, "row_id long, v string")


@pytest.mark.parametrize("broadcast", [False, True])
def test_insert_only_semantics(spark, broadcast):
    fact = keyed(spark, [(1, "a"), (2, "b"), (2, "b"), (None, "n")])
    batch = keyed(spark, [(2, "changed"), (3, "c"), (3, "c2"), (None, "n"), (None, "m")])
    got = inc.new_rows(batch, fact, broadcast_keys=broadcast).collect()
    assert sorted(map(tuple, got), key=str) == [(3, "c"), (3, "c2"), (None, "m"), (None, "n")]


def test_broadcast_form_never_shuffles_the_fact(spark, stage):
    fact = stage.put("fact", spark.range(100000).selectExpr("id AS row_id", "'x' AS v"))
    batch = stage.put("batch", spark.range(99990, 100010).selectExpr("id AS row_id", "'x' AS v"))
    df = inc.new_rows(batch, fact, broadcast_keys=True)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
    assert df.count() == 10


def test_loading_a_small_batch_never_shuffles_the_fact(spark, stage):
    fact = stage.put("old", spark.range(200000).selectExpr("id AS row_id", "'x' AS v"))
    batch = stage.put("more", spark.range(199990, 200010).selectExpr("id AS row_id", "'x' AS v"))
    df = inc.incremental_fact(fact, batch)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
    assert df.count() == 200010


def test_broadcast_is_decided_by_measured_size(spark):
    batch = keyed(spark, [(i, "x") for i in range(100)])
    assert inc.fits_broadcast(batch, "row_id")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit, fits in (("1k", False), ("-1", False), ("1m", True), ("10485760b", True)):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            assert inc.fits_broadcast(batch, "row_id") is fits
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_key_held_by_a_third_of_the_batch(spark):
    fact = keyed(spark, [(1, "a")])
    batch = keyed(spark, [(7, str(i)) for i in range(3000)] + [(None, str(i)) for i in range(3000)] + [(1, "x")])
    assert inc.new_rows(batch, fact).count() == 6000


def test_append_by_name(spark):
    target = spark.createDataFrame([(1, "a", 1.0)], "k long, s string, d double")
    got = inc.append_by_name(target, spark.createDataFrame([("b", 2)], "s string, k int"))
    assert [tuple(x) for x in got.orderBy("k").collect()] == [(1, "a", 1.0), (2, "b", None)]
    assert got.schema == target.schema or got.dtypes == target.dtypes
    with pytest.raises(ValueError, match="extra"):
        inc.append_by_name(target, spark.createDataFrame([(1,)], "extra int"))


def test_watermarks(spark):
    days = spark.createDataFrame([(dt.date(2017, 1, 3),), (dt.date(2016, 5, 1),), (None,)], "order_date date")
    assert inc.watermark_candidate(days).first()["watermark"] == "2017-01-03"
    assert inc.watermark_candidate(days.limit(0)).first()["watermark"] is None
    assert inc.later(dt.date(2017, 1, 1), dt.date(2016, 1, 1)) == dt.date(2017, 1, 1)
    assert inc.later(None, None) is None


# --- ids and samples ---------------------------------------------------------------------


@pytest.mark.parametrize("order", [None, ["k"]])
def test_row_ids_have_no_gaps(spark, stage, order):
    df = spark.range(5000).selectExpr("(id * 7919) % 5000 AS k").repartition(7)
    got = r.assign_row_ids(df, 101, stage, order).collect()
    assert sorted(x["row_id"] for x in got) == list(range(101, 5101))
    if order:
        assert all(x["row_id"] == 101 + x["k"] for x in got)


def test_row_ids_of_copies_and_of_nothing(spark, stage):
    copies = spark.range(3000).selectExpr("1 AS k")
    assert r.assign_row_ids(copies, 1, stage, ["k"]).agg({"row_id": "max"}).first()[0] == 3000
    assert r.assign_row_ids(copies.limit(0), 1, stage).count() == 0


def test_next_row_id(spark):
    assert r.next_row_id(keyed(spark, [(3, ""), (9, "")])) == 10
    assert r.next_row_id(keyed(spark, [])) == 1


def test_sample_size_and_repeatability(spark):
    df = spark.range(10000).withColumnRenamed("id", "row_id")
    first = [x[0] for x in r.sample_rows(df, 500, 3, "row_id").collect()]
    again = [x[0] for x in r.sample_rows(df.repartition(13), 500, 3, "row_id").collect()]
    assert len(set(first)) == 500 and first == again
    assert first != [x[0] for x in r.sample_rows(df, 500, 4, "row_id").collect()]
    assert 4000 < sum(first) / 500 < 6000
    assert r.sample_rows(df.limit(20), 500).count() == 20
