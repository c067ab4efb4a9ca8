import zlib
from collections import Counter, defaultdict

from helpers import ODD, documents, prose
from orderflow.llm import sharding


def run(docs, **options):
    return [r.asDict() for r in sharding.shard(docs, **options).collect()]


def check_slots(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    return by


def test_sizes_are_near_equal_and_small_groups_stay_together(spark):
    texts = [prose(i, 20 + i % 50) for i in range(600)] + [prose(9999, 30)] * 3
    rows = run(documents(spark, texts), shards=5, whole_copies=0.05)
    by = check_slots(rows)
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    total, most = sum(sizes.values()), max(r["size"] for r in rows)
    assert len(by) == 5 and len(rows) == 603
    assert all(abs(s - total / 5) <= 4 * most for s in sizes.values())
    assert len({r["shard"] for r in rows if r["text"] == prose(9999, 30)}) == 1


def test_a_text_with_most_of_the_rows_is_spread(spark):
    texts = [prose(1, 40)] * 300 + [prose(i, 40) for i in range(2, 150)]
    rows = run(documents(spark, texts), shards=4, ranges_per_shard=8)
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    check_slots(rows)
    assert max(sizes.values()) < 1.1 * min(sizes.values())


def test_odd_texts_sizes_and_sums(spark):
    rows = run(documents(spark, ODD), shards=3)
    assert len(rows) == len(ODD)
    check_slots(rows)
    for r in rows:
        data = (r["text"] or "").encode()
        assert r["size"] == len(data) + 8 and r["text_crc32"] == zlib.crc32(data)
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 3


def test_empty_table_clashing_columns_and_reruns(spark):
    assert run(documents(spark, [])) == []
    docs = documents(spark, [prose(i) for i in range(50)]).selectExpr("*", "'mine' AS shard", "7 AS Slot", "1 AS _size")
    rows = run(docs, shards=2)
    assert len(rows) == 50 and all(isinstance(r["shard"], int) for r in rows)
    place = lambda found: {r["doc_id"]: (r["shard"], r["slot"]) for r in found}
    assert place(rows) == place(run(docs.repartition(7), shards=2))


def test_written_shards_read_back(spark, tmp_path):
    docs = documents(spark, [prose(i) for i in range(40)])
    sharding.write_shards(sharding.shard(docs, shards=3), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 40 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2}
