"""The pipeline against a plain version of every stage, over a whole small table."""

import hashlib
import zlib

import corpus_pipeline
import numpy as np
import pytest
from helpers import documents, prose, words
from orderflow.llm import decontaminate, quality
from orderflow.llm.queries import tokenizer_path
from test_jaccard import brute
from test_mixing import water

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returns, the first being the input."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    out.append(docs.collect())
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, FOLDER).cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        out.append(docs.collect())
    out.append(corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect())
    return out


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_stages_are_the_operators_asked_for():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "n-gram Jaccard join", "benchmark decontamination",
        "mixing sources to target weights", "token-ID output",
    ]


def test_quality(spark, stages):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = quality.fit(docs, labels)
    good = [r.doc_id for r in stages[0] if model.score(*quality.encode([r.text]))[0] >= 0.5]
    assert ids(stages[1]) == sorted(good)
    wrong = {r.doc_id for r in labels.where("quality = 0").collect()} & set(good)
    clean = {r.doc_id for r in labels.where("quality = 1").collect()} - set(good)
    assert not wrong and len(clean) <= 1


def test_near_copies(stages):
    wanted = sorted({c for _, _, c in brute([(r.doc_id, r.text) for r in stages[1]])})
    assert ids(stages[2]) == wanted


def test_leaks(spark, stages):
    items = [" ".join(decontaminate.tokens(r.text)) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = [
        r.doc_id for r in stages[2] if not any(f" {i} " in f" {' '.join(decontaminate.tokens(r.text))} " for i in items)
    ]
    assert ids(stages[3]) == sorted(clean)
    assert len(stages[3]) < len(stages[2])


def test_mix(stages):
    sizes, by = {}, {}
    for r in stages[3]:
        n = len(words(r.text))
        sizes[r.source] = sizes.get(r.source, 0) + n
        key = hashlib.md5(f"{r.doc_id}|7|{hashlib.md5(r.text.encode()).hexdigest()}".encode()).hexdigest()
        by.setdefault(r.source, []).append((key, n, r.doc_id))
    target, wanted = water(sizes), []
    for source, rows in by.items():
        at, due = 0, {}
        for order, n, key in sorted(rows):
            due[order] = [sum(turn * sizes[source] + at + n / 2 < target[source] for turn in range(3)) if n else 0, n, key]
            at += n
        gap = target[source] - sum(c * n for c, n, _ in due.values())
        near = [
            (abs(n - abs(gap)), order) for order, (c, n, _) in due.items()
            if n and (c < 3 if gap > 0 else c > 0) and abs(n - abs(gap)) < abs(gap)
        ]
        if near:
            due[min(near)[1]][0] += 1 if gap > 0 else -1
        wanted += [key for c, _, key in due.values() for _ in range(c)]
    assert ids(stages[4]) == sorted(wanted)


def test_tokens(stages):
    from tokenizers import Tokenizer

    plain, start = Tokenizer.from_file(tokenizer_path()), 0
    order = sorted(stages[4], key=lambda r: (r.doc_id, r.text.encode()))
    for row, doc in zip(sorted(stages[5], key=lambda r: r.start), order, strict=True):
        tokens = np.array([*plain.encode(doc.text, add_special_tokens=False).ids, 2], "<u4")
        assert (row.doc_id, row.start, row.n_tokens) == (doc.doc_id, start, len(tokens))
        assert row.ids_crc32 == zlib.crc32(tokens.tobytes())
        start += len(tokens)


def test_run_is_the_stages(spark, stages):
    key = lambda r: (r.doc_id, r.start, r.n_tokens, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(key, stages[5]))


def test_extra_columns_and_empty_documents(spark):
    docs = documents(spark, [prose(i, 30) for i in range(8)] + [None, ""]).selectExpr("*", "1 AS score", "2 AS cls", "3 AS leaks")
    for rows in (docs, docs.limit(0)):
        frame = rows
        for _, step in corpus_pipeline.STAGES:
            frame = step(spark, frame, FOLDER)
        assert frame.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        assert (frame.count() > 0) == (rows.count() > 0)
