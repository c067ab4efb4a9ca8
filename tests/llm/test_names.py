"""Columns that are named like anything an operator names inside are handed through as they came."""

import inspect
import re

import duckdb
import pytest
from helpers import documents, prose
from orderflow.llm import common, decontaminate, htmltext, jaccard, mixing, quality, sharding, tokenfiles, warc
from orderflow.llm.queries import ORACLE, QUERIES

NAME = re.compile(r"""["'](_?[a-z][a-z_0-9]*)["']""")


def inside(*modules):
    """Every quoted name of the modules."""
    return sorted({n for m in modules for n in NAME.findall(inspect.getsource(m))})


def crowded(frame, names, leave=()):
    there = {c.lower() for c in frame.columns} | set(leave)
    extra = [n for n in names if n not in there]
    return frame.selectExpr("*", *(f"{i} AS `{n}`" for i, n in enumerate(extra))), {n: i for i, n in enumerate(extra)}


OPERATORS = {
    "mixing": (mixing.mix, [mixing], mixing.ADDED),
    "sharding": (sharding.shard, [sharding], sharding.ADDED),
    "one_of_each": (jaccard.one_of_each, [jaccard], ()),
    "decontaminated": (lambda d: decontaminate.decontaminated(d, d.sparkSession.createDataFrame([(1, "zz yy")], "item_id long, text string")),
                       [decontaminate], ()),
    "score": (lambda d: quality.score(d, None), [quality], ("score",)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_internal_names_are_handed_through(spark, name):
    apply, modules, added = OPERATORS[name]
    docs, extra = crowded(documents(spark, [prose(i, 12) for i in range(9)]), inside(*modules, common), added)
    assert len(extra) > 8
    rows = [r.asDict() for r in apply(docs).collect()]
    assert len(rows) == 9 and {r["doc_id"] for r in rows} == set(range(9))
    assert all({n: r[n] for n in extra} == extra and r["text"] == prose(r["doc_id"], 12) for r in rows)


def test_pages_and_records(spark):
    pages = spark.createDataFrame([(i, f"http://a.b/{i}", f"<p>{prose(i)}</p>") for i in range(3)], "page_id long, url string, html string")
    made, extra = crowded(pages, inside(htmltext, common), ("text",))
    rows = [r.asDict() for r in htmltext.main_text(made).collect()]
    assert len(rows) == 3 and all({n: r[n] for n in extra} == extra for r in rows)
    own = [c.split()[0] for c in warc.RECORD.split(", ")]
    made, extra = crowded(warc.responses(pages), own)
    rows = [r.asDict() for r in warc.derive(made, keep=[*extra, "record_id"]).collect()]
    assert len(rows) == 6 and all(r[f"_{n}"] == v and r[n] != v for r in rows for n, v in extra.items())
    assert all(r["_record_id"] == r["refers_to"] for r in rows)


@pytest.mark.parametrize("key", ["part", "place", "tokens", "n_tokens", "ids_crc32", "start", "_text", "_offset", "_inside", "_all"])
def test_keys_of_token_files_may_have_any_name(spark, tmp_path, key):
    from orderflow.llm.queries import tokenizer_path

    docs = spark.createDataFrame([(i, prose(i, 4)) for i in range(3)], f"{key} long, text string")
    tokenfiles.write_tokens(docs, str(tmp_path), tokenizer_path(), key=key)
    found = tokenfiles.with_starts(spark, str(tmp_path), key)
    name = tokenfiles.key_name(key)
    assert sorted(r[name] for r in found.collect()) == [0, 1, 2]


def test_a_line_end_in_a_url_begins_no_header(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/\r\nWARC-Type: x\r\nb", "<p>x</p>")], "page_id long, url string, html string")
    warc.write_records(warc.derive(warc.responses(pages)), str(tmp_path / "w"))
    found = warc.read_records(spark, str(tmp_path / "w")).collect()
    assert sorted(r.headers["WARC-Type"] for r in found) == ["conversion", "metadata"]


@pytest.mark.parametrize("copies", [1, 60])
def test_the_mix_and_its_sql_agree_on_repeated_rows(spark, tmp_path, copies):
    texts = [(k, prose(k, 3 + k % 17)) for k in range(120)] + [(7, prose(7, 31))] * copies + [(None, None), (8, "")]
    documents(spark, texts, ("a", "b", "c", "d", None)).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    columns = ["doc_id", "size", "source_size", "target", "taken", "training_times"]
    key = lambda r: tuple((v is None, v) for v in r)
    ours = sorted((tuple(r) for r in QUERIES["op9_curriculum_mix"](spark, str(tmp_path)).select(*columns).collect()), key=key)
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        theirs = sorted(db.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE['op9_curriculum_mix']})").fetchall(), key=key)
    assert ours == theirs and any(r[5] for r in ours)
