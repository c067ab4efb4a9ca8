from collections import defaultdict

import pytest
from helpers import ODD, documents, prose, words
from orderflow.llm import mixing
from orderflow.llm.queries import QUERIES


def water(sizes, weights=(5, 2, 1), limit=3):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(limit * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        shares = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if shares[s] > limit * sizes[s]}
        if not over:
            return {s: limit * sizes[s] if s in full else shares[s] for s in names}
        full |= over


def run(docs, **options):
    return [r.asDict() for r in mixing.mix(docs, **options).collect()]


def test_targets_are_met_within_a_document(spark):
    texts = [prose(i, 5 + i % 40) for i in range(400)]
    rows = run(documents(spark, texts, ("a",) * 1 + ("b", "c", "c", "c", "c", None)))
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["size"] == len(words(r["text"])) and r["taken"] in {k * r["size"] for k in range(4)}
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    wanted = water(sizes)
    for r in rows:
        assert r["target"] == pytest.approx(wanted[r["source"]]) and r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - wanted[s]) <= most[s] / 4 for s in sizes)


def test_a_small_heavy_source_is_full_and_its_excess_shared(spark):
    texts = [prose(0, 4)] + [prose(i, 100) for i in range(1, 40)]
    docs = documents(spark, texts, ("a",) + ("b", "c", "d") * 13)
    rows = run(docs)
    first = next(r for r in rows if r["source"] == "a")
    assert first["target"] == 12 and first["taken"] == 12
    assert sum(r["taken"] for r in rows) == pytest.approx(3904, abs=400)


def test_positions_follow_the_schedule_and_the_order_is_by_position(spark):
    docs = documents(spark, [prose(i, 10) for i in range(600)], ("a", "b", "c"))
    mixed = mixing.mix(docs)
    copies = [r.asDict() for r in mixing.in_training_order(mixed).collect()]
    places = [c["position"] for c in copies]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1
    # Weight 1 - s + 2 s t: half of the time has taken (1 - s) / 2 + s / 4 of the words.
    for source, slope in (("a", 0.5), ("b", -0.5), ("c", 0.0)):
        own = [c["position"] for c in copies if c["source"] == source]
        assert sum(p < 0.5 for p in own) / len(own) == pytest.approx((1 - slope) / 2 + slope / 4, abs=0.02)


def test_odd_texts_empty_tables_and_reruns(spark):
    docs = documents(spark, ODD)
    rows = run(docs)
    assert len(rows) == len(ODD)
    assert all(r["taken"] == 0 for r in rows if not words(r["text"]))
    assert run(documents(spark, [])) == [] and all(r["target"] == 0 for r in run(documents(spark, ["", None])))
    clash = docs.selectExpr("*", "'x' AS target", "1 AS Size")
    key = lambda found: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in found)
    assert key(run(clash)) == key(run(docs.repartition(5))) == key(rows)


def test_of_repeated_rows_one_makes_up_the_gap(spark):
    """Sources mostly of one short row: where a long text ends the last pass, one copy more or less is taken."""
    rows = []
    for source in "abcdefghijkl":
        short, long = prose(source, 3), [prose(source + x, 60) for x in "12"]
        rows += [(1, short, "en", source, 0)] * 40 + [(k, t, "en", source, 0) for k, t in enumerate(long, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found, taken, target = run(docs.repartition(3)), defaultdict(int), {}
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert len(found) == len(rows) and all(abs(taken[s] - target[s]) <= 30 for s in target)


def test_the_training_order_is_registered_with_ranks(spark, tmp_path):
    """Every taken copy once, at the time its source's schedule gives it, ranked by that time."""
    docs = documents(spark, [prose(i, 1 + i % 23) for i in range(300)], ("a", "b", "c", "d"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [r.asDict() for r in QUERIES["curriculum_training_order"](spark, str(tmp_path)).collect()]
    rows.sort(key=lambda r: r["rank"])
    assert [r["rank"] for r in rows] == list(range(len(rows)))
    order = [(r["position"], r["source"], r["doc_id"]) for r in rows]
    assert order == sorted(order)
    taken, target = defaultdict(int), {}
    for r in run(docs):
        taken[r["doc_id"]] += r["taken"]
        target[r["source"]] = r["target"]
    copied = defaultdict(int)
    for r in rows:
        copied[r["doc_id"]] += r["size"]
    assert copied == {k: n for k, n in taken.items() if n}
    for source, slope in (("a", 0.5), ("b", -0.5), ("c", 0.0), ("d", 0.5)):
        own = [r for r in rows if r["source"] == source]
        half = sum(r["size"] for r in own if r["position"] < 0.5) / target[source]
        assert half == pytest.approx((1 - slope) / 2 + slope / 4, abs=0.05)
