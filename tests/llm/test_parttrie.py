import hashlib
import math
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from orderflow.llm import exact, parttrie

SCHEMA = "vec_id long, embedding array<double>, label int"
NAN, INF = float("nan"), float("inf")


def plain(rows, positions=4, entries=256, rounds=4, scale=1024):
    """The contract, step by step, in Python's own numbers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    sizes = Counter(len(v) for _, v, _ in kept if v and len(v) % positions == 0)
    dims = max(sizes, key=lambda d: (sizes[d], d), default=0)
    width = dims // positions
    cut = lambda v: [
        [math.floor(Fraction(x) * scale) for x in v[p * width : (p + 1) * width]] for p in range(positions)
    ]
    fit = sorted((r for r in kept if len(r[1]) == dims and dims), key=lambda r: (r[0] is None, r[0], r[1]))
    books = [[cut(v)[p] for _, v, _ in fit[:entries]] for p in range(positions)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(positions):
            groups = defaultdict(list)
            for _, v, _ in fit:
                groups[nearest(p, cut(v)[p])[1]].append(cut(v)[p])
            books[p] = [
                [sum(x) // len(groups[i]) for x in zip(*groups[i])] if groups[i] else e for i, e in enumerate(books[p])
            ]
    out, by_label = [], Counter()
    for key, v, label in kept:
        if len(v) != dims or not dims:
            out.append((key, label, None, None))
            continue
        found = [nearest(p, part) for p, part in enumerate(cut(v))]
        error = sum(d for d, _ in found)
        error = error if error < 2**63 else None
        by_label[label] += error or 0
        out.append((key, label, "".join(f"{i:02x}" for _, i in found), error))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = {label for _, label, _, error in out if error is not None}
    return sorted(
        ((k, c, e, by_label[lab] if lab in coded else None, digest) for k, lab, c, e in out), key=str
    )


def run(frame, **options):
    found = parttrie.compress(frame, **options)
    return sorted((tuple(r) for r in found.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def vectors(seed, n, dims=8, kinds=6, step=0.01):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(kinds, dims)) / 4
    x = np.round((centre[rng.integers(0, kinds, n)] + rng.normal(size=(n, dims)) * 0.02) / step) * step
    return [(i, v.tolist(), [None, 1, 2][i % 3]) for i, v in enumerate(x)]


@pytest.mark.parametrize(("entries", "rounds"), [(16, 4), (256, 2)])
def test_whole_result_against_a_plain_version(spark, entries, rounds):
    rows = vectors(1, 300)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert run(frame, entries=entries, rounds=rounds) == plain(rows, entries=entries, rounds=rounds)


def test_odd_rows(spark):
    good = vectors(2, 40)
    odd = [
        (100, None, 1), (101, [], 1), (102, [0.1, None] * 4, 2), (103, [NAN] * 8, 2), (104, [INF] * 8, 2),
        (105, [0.5] * 4, 9), (106, [0.5] * 7, 2), (None, [0.25] * 8, None), (None, [-0.25] * 8, None),
        (3, good[3][1], 1), (3, good[5][1], 1), (107, [-0.0] * 8, 2), (108, [1e-300] * 8, 2),
    ]
    rows = good + odd
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(3), entries=12) == plain(rows, entries=12)


def test_numbers_beyond_a_long(spark):
    rows = vectors(3, 12) + [(50, [1e30, -3e30] * 4, 7), (51, [1e30] * 8, 7), (52, [2e12] * 8, 8)]
    got = run(spark.createDataFrame(rows, SCHEMA), entries=5, rounds=3)
    assert got == plain(rows, entries=5, rounds=3) and any(r[2] is None and r[1] for r in got)


def test_repeated_rows_count_and_stay(spark):
    rows = vectors(4, 30) + [(7, vectors(4, 30)[7][1], 1)] * 200
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(4), entries=9) == plain(rows, entries=9)


def test_clashing_columns_are_ignored_and_empty_tables_stay_empty(spark):
    rows = vectors(5, 25)
    names = ["code", "error", "label_error", "codebooks_sha256", "position", "part", "n", "vector", "entry", "slot", "limb", "value", "dims", "peak"]
    frame = spark.createDataFrame([(*r, *[0] * len(names)) for r in rows], SCHEMA + "".join(f", {n} int" for n in names))
    assert run(frame, entries=6) == plain(rows, entries=6)
    assert run(spark.createDataFrame([], SCHEMA)) == []
    assert run(spark.createDataFrame([(1, [0.5], 1), (2, None, 1)], SCHEMA)) == plain([(1, [0.5], 1)])


def test_prefixes_are_computed_once(monkeypatch):
    """The trie has far fewer nodes than the parts have components."""
    x = np.repeat(np.arange(4), 700).reshape(-1, 1) * np.ones((1, 6), int)
    x[:, 5] = np.arange(len(x)) % 700
    book = np.arange(30).reshape(5, 6)
    x = x[parttrie.sorted_rows(x)]
    nodes = []
    whole = np.concatenate
    monkeypatch.setattr(parttrie.np, "concatenate", lambda parts: nodes.append(len(parts[1])) or whole(parts))
    walk = parttrie.Walk(book)
    found = [(e, d) for _, entry, distance in walk.leaves(x) for e, d in zip(entry.tolist(), distance.tolist())]
    far = ((x[:, None, :] - book) ** 2).sum(2)
    assert found == list(zip(far.argmin(1).tolist(), far.min(1).tolist()))
    # After the first block only new nodes are grown: a leaf each, and paths that change.
    assert sum(nodes) < 2 * len(x)


def test_sums_in_limbs():
    for value in (0, 5, -5, 2**31, -(2**64) - 3, 10**40):
        assert sum(v << (32 * i) for i, v in enumerate(exact.limbs(value))) == value
