import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from helpers import ODD, documents, prose
from orderflow.llm import common, tokenfiles
from orderflow.llm.queries import tokenizer_path

TRICKY = [
    "a  b", "a\n\nb", " lead", "trail ", "x\n y", "<|endoftext|> hi", "tab\tx", "don't we'll 12 3.5 !!", "a\0b",
    "\x1c a", "日本 語 😀 ok", "word*** two&&& ... , .", "x\r\ny", "'s 's, it's.", "  a", "1. 2, ½!",
]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer_path())
    return lambda text: found.encode(text or "", add_special_tokens=False).ids + [2]


def test_cached_words_give_the_same_ids(plain, monkeypatch):
    monkeypatch.setattr(tokenfiles, "CACHED", 50)
    encode = tokenfiles.Encoder(tokenizer_path(), 2)
    texts = TRICKY + [prose(i, 80) for i in range(30)] + TRICKY
    for start in range(0, len(texts), 7):
        for text, ids in zip(texts[start : start + 7], encode(texts[start : start + 7])):
            assert np.frombuffer(ids, "<u4").tolist() == plain(text), text


def test_round_trip_starts_and_digests(spark, tmp_path, plain):
    texts = [prose(i, 1 + i % 90) for i in range(200)] + ODD + TRICKY
    docs = documents(spark, texts)
    tokenfiles.write_tokens(docs.repartition(6), str(tmp_path / "t"), tokenizer_path())
    rows = tokenfiles.with_starts(spark, str(tmp_path / "t")).collect()
    order = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, (r.text or "").encode()))
    start = 0
    for row, doc in zip(sorted(rows, key=lambda r: r.start), order, strict=True):
        ids = plain(doc.text)
        assert (row.doc_id, row.start, row.n_tokens) == (doc.doc_id, start, len(ids))
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_layout_and_selective_reads(spark, tmp_path):
    docs = documents(spark, [prose(i, 50) for i in range(3000)])
    folder = str(tmp_path / "t")
    tokenfiles.write_tokens(docs, folder, tokenizer_path())
    file = next(f for f in (tmp_path / "t").iterdir() if f.suffix == ".parquet")
    group = pq.ParquetFile(file).metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert "RLE_DICTIONARY" in columns["tokens.list.element"].encodings
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert all(c.has_offset_index and c.has_column_index for c in columns.values())
    narrow = tokenfiles.read_tokens(spark, folder, "doc_id", "n_tokens").where("doc_id = 7")
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan and "EqualTo(doc_id,7)" in plan
    assert narrow.count() == 1


def test_empty_table(spark, tmp_path):
    tokenfiles.write_tokens(documents(spark, []), str(tmp_path / "t"), tokenizer_path())
    assert tokenfiles.with_starts(spark, str(tmp_path / "t")).count() == 0


def test_words_are_dropped_once_nobody_wants_them(monkeypatch):
    import time

    monkeypatch.setattr(tokenfiles, "IDLE_SECONDS", 0.3)
    words = tokenfiles.Encoder(tokenizer_path(), 2).known
    whole = words["kept"]
    words.wanted(now=False)
    words.wanted(now=True)
    time.sleep(0.6)
    assert "kept" in words
    words.wanted(now=False)
    time.sleep(0.6)
    assert not len(words) and words["kept"] == whole


def test_common_words_outlast_the_bound(monkeypatch):
    monkeypatch.setattr(tokenfiles, "CACHED", 60)
    words, asked = tokenfiles.Encoder(tokenizer_path(), 2).known, []
    merges, most = words.merges, 0
    words.merges = lambda text: asked.append(text) or merges(text)
    for i in range(400):
        words["common"], words["rare" + "abcdefghij"[i % 10] * (i // 10 + 1)]
        most = max(most, len(words) + len(words.earlier))
    assert asked.count("common") == 1 and most <= 62


def test_digests_need_no_words():
    words = tokenfiles.encoder(tokenizer_path(), 2).known
    words["kept"]
    words.wanted(now=False)
    tokenfiles.forget_words()
    assert not len(words) and not words.earlier and words.timer is None and words.held == 0


def test_memory_goes_back_when_words_are_dropped_and_tasks_end(monkeypatch):
    import pyarrow as pa

    asked = []
    monkeypatch.setattr(common, "give_back", lambda: asked.append("task"))
    monkeypatch.setattr(tokenfiles, "give_back", lambda: asked.append("words"))
    batch = pa.RecordBatch.from_arrays([pa.array(["one", None, "two"])], ["t"])
    assert [b.num_rows for b in common.slices(iter([batch]), "t", 1)] == [1, 2] and asked == ["task"]
    tokenfiles.encoder(tokenizer_path(), 2)
    tokenfiles.forget_words()
    assert "words" in asked


def test_giving_back_needs_no_special_c_library(monkeypatch):
    monkeypatch.setattr(common.ctypes, "CDLL", lambda name: object())
    common._trim.cache_clear()
    common.give_back()
    common._trim.cache_clear()
