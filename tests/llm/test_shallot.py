import hashlib
import math
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from orderflow.llm import shallot

SCHEMA = "vec_id long, embedding array<double>, label int"
NAN, INF = float("nan"), float("inf")


def plain(rows, count=40, rounds=5, dims=64, scale=256):
    """Every distance to every centroid, in Python's own numbers."""
    kept = [
        (k, v, [math.floor(Fraction(x) * scale) for x in v])
        for k, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    name = lambda k: hashlib.sha256(f"2:{'' if k is None else k}".encode()).hexdigest()
    centroids = [w for _, _, w in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:count]]
    far = lambda w: min((sum((a - b) ** 2 for a, b in zip(w, c)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, _, w in kept:
            groups[far(w)[1]].append(w)
        centroids = [[sum(x) // len(groups[i]) for x in zip(*groups[i])] if groups[i] else c for i, c in enumerate(centroids)]
    found = [(k, *far(w)) for k, _, w in kept]
    inertia = Counter()
    for _, d, c in found:
        inertia[c] += d
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    small = lambda v: v if v < 2**63 else None
    return sorted(
        ((k, c, small(d), small(inertia[c]), small(sum(inertia.values())), shas[c]) for k, d, c in found), key=str
    )


def run(frame, **options):
    found = shallot.cluster(frame, **options)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def vectors(seed, n, dims, kinds=9, spread=0.1, step=None):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(kinds, dims)) / 3
    x = centre[rng.integers(0, kinds, n)] + spread * rng.normal(size=(n, dims))
    x = np.round(x / step) * step if step else x
    return [(i, v.tolist()) for i, v in enumerate(x)]


def frame_of(spark, rows, parts=4):
    return spark.createDataFrame([(k, v, 0) for k, v in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize(("dims", "count", "step"), [(64, 40, None), (3, 25, 0.25), (2, 7, 0.5), (1, 12, 0.01)])
def test_whole_result_against_a_plain_version(spark, dims, count, step):
    """Coarse steps make many ties between centroids and many equal vectors."""
    rows = vectors(dims, 400, dims, step=step)
    assert run(frame_of(spark, rows), dims=dims, count=count) == plain(rows, dims=dims, count=count)


def test_odd_rows(spark):
    good = vectors(2, 60, 4)
    odd = [
        (100, None), (101, []), (102, [0.1, None, 0.1, 0.1]), (103, [NAN] * 4), (104, [-INF] * 4), (105, [0.5] * 3),
        (106, [0.5] * 5), (None, [0.25] * 4), (None, [-0.25] * 4), (3, good[3][1]), (3, good[9][1]), (107, [-0.0] * 4),
    ]
    rows = good + odd
    assert run(frame_of(spark, rows), dims=4, count=10) == plain(rows, dims=4, count=10)


@pytest.mark.parametrize("count", [1, 2, 500])
def test_few_and_many_centroids(spark, count):
    rows = vectors(3, 80, 4)
    assert run(frame_of(spark, rows), dims=4, count=count, rounds=3) == plain(rows, dims=4, count=count, rounds=3)


def test_numbers_beyond_a_long(spark):
    rows = vectors(4, 20, 4) + [(50, [1e30, -3e30, 1e30, 0.0]), (51, [1e30] * 4), (52, [1e200, 0.0, 0.0, 1.0]), (53, [1e9] * 4)]
    assert run(frame_of(spark, rows), dims=4, count=6, rounds=3) == plain(rows, dims=4, count=6, rounds=3)


def test_repeated_rows_and_equal_centroids(spark):
    rows = [(i % 3, [0.5, 0.25]) for i in range(50)] + vectors(5, 30, 2)
    assert run(frame_of(spark, rows), dims=2, count=12) == plain(rows, dims=2, count=12)


def test_clashing_columns_are_ignored_and_empty_tables_stay_empty(spark):
    rows = vectors(6, 40, 4)
    names = ["cluster", "distance", "inertia", "cluster_inertia", "centroid_sha256", "whole", "second", "upper", "lower", "vector"]
    schema = "vec_id long, embedding array<double>" + "".join(f", {n} int" for n in names)
    frame = spark.createDataFrame([(*r, *[0] * len(names)) for r in rows], schema)
    assert run(frame, dims=4, count=5) == plain(rows, dims=4, count=5)
    assert run(spark.createDataFrame([], SCHEMA)) == [] == run(spark.createDataFrame([(1, None, 0)], SCHEMA))


def test_bounds_and_shrinking_balls_save_distances(monkeypatch):
    """Most distances to centroids are never taken, and the result is that of taking all."""
    rng = np.random.default_rng(8)
    x = np.rint((rng.normal(size=(40, 6)) * 300)[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 6)) * 12).astype(np.int64)
    taken, real = [], shallot.squares
    monkeypatch.setattr(shallot, "squares", lambda a, b: taken.append(len(a)) or real(a, b))
    centroids, before = x[:40].astype(object), None
    state = [np.zeros(len(x), np.int32), np.ones(len(x), np.int32), np.full(len(x), np.inf), np.zeros(len(x))]
    for n in range(6):
        taken.clear()
        state = list(shallot.assign(x, *state, shallot.Geometry.of(centroids, before), centroids.astype(np.int64)))
        far = ((x[:, None, :] - centroids.astype(np.int64)) ** 2).sum(2)
        assert (state[0] == far.argmin(1)).all()
        exact = np.sqrt(np.sort(far, 1)[:, :2].astype(float))
        assert (state[2] >= exact[:, 0]).all() and (state[3] <= exact[:, 1]).all()
        assert sum(taken) < len(x) * (12 if n else 35)
        named = [x[state[0] == c] for c in range(40)]
        means = [[int(v) // len(m) for v in m.sum(0)] if len(m) else list(c) for m, c in zip(named, centroids)]
        before, centroids = centroids, np.array(means, object)
    assert sum(taken) < len(x)
