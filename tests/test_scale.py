"""What keeps the steps over order lines in bounds as the tables grow."""

from datetime import date, datetime

from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import ROWS, changed, make
from orderflow import session
from orderflow.operators import clean, features
from orderflow.plans import gold, maintained
from orderflow.sources import export
from orderflow.sources.conformed import conformed_sales
from orderflow.sources.lake import FACT, GOLD_NAMES, MONTH, Lake, by_month


def plan(df):
    return df._jdf.queryExecution().toString()


def test_partitions_of_order_lines_are_small_and_many():
    class Conf(dict):
        set, unset = dict.__setitem__, dict.pop
        getAll = lambda self: [("spark.sql.adaptive.enabled", "false")]

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"getConf": staticmethod(Conf)})

    entry._tuned(lambda s, folder: None)(Session, "")
    assert Session.conf["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == "8m"
    assert int(Session.conf["spark.sql.adaptive.coalescePartitions.initialPartitionNum"]) > 200
    # A query that does not want them leaves Spark's own.
    Session.conf["spark.sql.adaptive.enabled"] = "false"
    session.apply(Session, session.BASE)
    assert Session.conf.keys() == session.BASE.keys() and session.SETTINGS.keys() > session.BASE.keys()


def test_derived_columns_are_made_behind_the_shuffle(spark):
    rows = [*changed(0, order_date=None, sales=0.0, profit=None), *ROWS]
    fact = features.engineer(clean.clean(make(spark, rows)))
    laid_out = by_month(fact, derive=features.engineer)
    assert laid_out.columns == [*fact.columns, MONTH]
    assert sorted(laid_out.collect(), key=str) == sorted(by_month(fact).collect(), key=str)
    below = plan(laid_out).split("RebalancePartitions")[-1]
    assert "profit_tier" not in below


def test_a_stored_fact_is_exported_as_it_lies(spark, tmp_path, monkeypatch):
    lake = Lake(spark, str(tmp_path / "lake"))
    fact = features.engineer(clean.clean(make(spark, changed(0, order_date=None))))
    late = fact.withColumns({"row_id": F.col("row_id") + 100, "order_date": F.lit(date(2020, 2, 3))})
    for df, mode in ((fact, "overwrite"), (late, "append")):
        lake.write_fact(df, mode, features.engineer)
    for name, df in gold.all_tables(lake.read(FACT)).items():
        lake.replace(name, df)

    def shuffled(*_):
        raise AssertionError("the fact is shuffled again")

    monkeypatch.setattr(export, "by_month", shuffled)
    target = str(tmp_path / "out")
    frames = export.stored_tables(lake)
    export.export_tables(frames, target)
    parity = export.row_count_parity(spark, frames, target).collect()
    assert len(parity) == 1 + len(GOLD_NAMES) and all(r["matches"] for r in parity)
    written = spark.read.parquet(f"{target}/{FACT}")
    assert sorted(written.drop(MONTH).collect(), key=str) == sorted(lake.read(FACT).select(written.drop(MONTH).columns).collect(), key=str)
    months = {(r[0], r[1]) for r in written.select(MONTH, F.trunc("order_date", "month")).collect()}
    assert all(a == b for a, b in months) and (None, None) in months


def test_sums_of_a_state_are_added_in_one_shuffle(spark):
    fact = features.engineer(clean.clean(make(spark, ROWS)))
    parts = gold.line_parts(fact)
    pairs = {"order_id": maintained.distinct_pairs(gold.PRODUCT, parts, "order_id").localCheckpoint()}
    sums = maintained.counted(gold.PRODUCT, None, parts.localCheckpoint(), pairs)
    assert plan(sums).split("== Physical Plan ==")[1].count("Exchange") == 1
    again = maintained.counted(gold.PRODUCT, sums, parts.limit(0), {"order_id": pairs["order_id"].limit(0)})
    want = gold.PRODUCT.from_parts(parts)
    for found in (sums, again):
        table = gold.PRODUCT.from_sums(found)
        assert sorted(table.collect(), key=str) == sorted(want.collect(), key=str)


def test_no_generated_method_is_larger_than_the_jvm_compiles():
    assert int(session.SETTINGS["spark.sql.codegen.hugeMethodLimit"]) <= 8000


def test_no_shuffle_of_the_lines_carries_country_names(spark, tmp_path):
    star = {
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(1, "PERU", 1)]),
        "region": ("r_regionkey int, r_name string", [(1, "AMERICA")]),
        "customer": ("c_custkey long, c_name string, c_nationkey int, c_mktsegment string", [(4, "Ann", 1, "BUILDING")]),
        "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_retailprice double",
                 [(7, "hot bolt", "Brand#1", "SMALL", 9.5)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string",
                   [(2, 4, datetime(2000, 3, 9, 13), "2-HIGH")]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,"
                     "l_extendedprice double, l_discount double, l_shipdate timestamp",
                     [(2, 7, 3, 1, 2.0, 100.0, 0.1, datetime(2000, 3, 11, 1)), (2, 8, 3, 2, 2.0, 1.0, 0.1, None)]),
    }
    for name, (schema, rows) in star.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    df = conformed_sales(spark, str(tmp_path))
    (row,) = df.collect()
    assert (row["row_id"], row["order_id"], row["product_id"], row["country"], row["region"]) == ("2-1-7-3", 2, 7, "PERU", "AMERICA")
    assert (row["order_date"], row["ship_date"], row["sales"]) == (date(2000, 3, 9), date(2000, 3, 11), 90.0)
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in plan]
    top = next(i for i, line in enumerate(plan) if "Join Inner, (l_partkey" in line)
    below = [line for i, line in enumerate(plan) if i > top and min(depth[top + 1 : i + 1]) > depth[top]]
    assert any("l_orderkey" in line for line in below)
    assert not any("n_name" in line or "r_name" in line or "timestamp" in line for line in below)
