import random

import numpy as np
import pandas as pd
import pytest
from helpers import ODD, documents, prose, words
from orderflow.llm import jaccard


def sets_of(texts):
    out = []
    for t in texts:
        w = words(t)
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    return out


def brute(rows):
    """Smallest id that links reach, by comparing all pairs."""
    sets = sets_of([t for _, t in rows])
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    ids = lambda i: [k for (k, _), x in zip(rows, label) if x == label[i] and k is not None]
    return [(k, len(sets[i]), min(ids(i), default=None)) for i, (k, _) in enumerate(rows)]


def changed(text, rng, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = prose(rng.random(), 1)
    return " ".join(w)


def found(docs, **options):
    order = lambda r: tuple((x is None, x or 0) for x in r)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar(docs, **options).collect()), key=order)


def same(spark, rows, **options):
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert found(documents(spark, rows), **options) == sorted(brute(rows), key=order)


@pytest.mark.parametrize("short", [32, 1])
def test_like_comparing_all_pairs(spark, monkeypatch, short):
    # With short=1 every list is long, so that families and blocks do all of the last step.
    linked = jaccard._linked
    monkeypatch.setattr(jaccard, "_linked", lambda *a: linked(*a, short))
    rng = random.Random(4)
    texts = []
    for i in range(40):
        base = prose(i, rng.choice([3, 6, 40, 90]))
        texts += [base] + [changed(base, rng, rng.randrange(4)) for _ in range(rng.randrange(4))]
        if i % 5 == 0:
            texts.append(base.upper() + " " + prose(500, 30))
    rng.shuffle(texts)
    rows = [(3 * i % 1000, t) for i, t in enumerate(texts)]
    same(spark, rows, rounds=1)


def test_a_family_at_the_edge_of_the_threshold(spark, monkeypatch):
    rng, base = random.Random(8), prose(1, 100)
    monkeypatch.setattr(jaccard._family_links, "__defaults__", (20, 2000))
    rows = [(i, changed(base, rng, rng.randrange(6))) for i in range(150)]
    same(spark, rows, rounds=0)


def test_odd_texts_ties_and_ids(spark):
    same(spark, [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(ODD)] + [(None, "no id"), (7, None)])
    assert found(documents(spark, [])) == []
    assert found(documents(spark, [None, " "])) == [(0, 0, 0), (1, 0, 1)]


def test_the_threshold_is_met_exactly(spark):
    # 18 and 18 shingles with 16 in common: 16 of 20.
    base = [f"w{i}" for i in range(22)]
    rows = [(1, " ".join(base)), (2, " ".join(["x", "y", *base[2:]])), (3, " ".join(["x", "y", "z", *base[3:]]))]
    same(spark, rows)


def test_copies_in_many_packs_are_one_class(spark, monkeypatch):
    monkeypatch.setattr(jaccard._dealt, "__defaults__", (300,))
    rng = random.Random(5)
    texts = [prose(i % 30, 50) for i in range(90)] + [changed(prose(3, 50), rng, 1) for _ in range(10)]
    same(spark, list(enumerate(texts)))


@pytest.mark.parametrize("seed", range(30))
def test_multi_match_prefixes_lose_no_pair(seed):
    """Linked sets have min(l) shingles in common whose l is at most that, whatever each chose."""
    rng = random.Random(seed)
    base = set(rng.sample(range(300), rng.randrange(5, 60)))
    a, b = base | set(rng.sample(range(300, 400), rng.randrange(3))), set(base)
    for x in rng.sample(sorted(b), min(len(b) - 1, rng.randrange(4))):
        b.discard(x)
    if 100 * len(a & b) < 80 * len(a | b):
        return
    frequency = {x: rng.randrange(2, 50) for x in a & b}
    sides = []
    for s in (a, b):
        order = sorted((frequency[x], x) for x in s if x in frequency)
        asked, enters = jaccard.adaptive_length(len(s), np.array([f for f, _ in order]), 80, most=rng.randrange(1, 6))
        sides.append((asked, {x: e for (_, x), e in zip(order, enters.tolist())}))
    (la, ea), (lb, eb) = sides
    least = min(la, lb)
    assert sum(max(ea[x], eb[x]) <= least for x in ea.keys() & eb.keys()) >= least


def test_longer_prefixes_where_they_cost_less():
    assert jaccard.adaptive_length(100, np.full(100, 2), 80)[0] > 1
    assert jaccard.adaptive_length(10, np.array([2] * 3 + [10_000] * 7), 80)[0] == 1


def test_links_inside_a_block_join_components_once():
    sets = [np.array([1, 2, 3, 4, 5]), np.array([1, 2, 3, 4, 5]), np.array([1, 2, 3, 4, 6]), np.array([9])]
    rows = pd.DataFrame({"cls": range(4), "n": [5, 5, 5, 1], "shared": sets, "comp": range(4), "block": 0, "i": 0, "j": 0})
    assert len(jaccard._links_in(rows, 60)) == 2


def test_one_of_each_keeps_columns_and_one_document(spark):
    texts = [prose(1), prose(1), prose(2), None, "", (0, prose(1)), (9, prose(2) + " tail")]
    docs = documents(spark, texts).selectExpr("*", "doc_id AS cls", "'t' AS _text")
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4]


def test_words_are_hashed_in_small_slices():
    import tracemalloc

    import pyarrow as pa
    from orderflow.llm import common

    batch = pa.RecordBatch.from_arrays([pa.array(["some words of a text " * 500] * 200)], ["t"])
    tracemalloc.start()
    for part in common.slices(iter([batch]), "t", common.SLICE):
        common.hashed_words(part.column(0).to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert batch.nbytes > 2 << 20 and peak < 48 << 20
