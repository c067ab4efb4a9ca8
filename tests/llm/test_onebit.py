import numpy as np
import pytest
from orderflow.llm import onebit

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(seed, n, dims, kinds=12, spread=0.6):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(kinds, dims))
    return (centre[rng.integers(0, kinds, n)] + spread * rng.normal(size=(n, dims))).astype(np.float32)


def brute(rows, k, every):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v]
    out = {}
    for q, v in usable:
        if q % every == 0:
            cosine = lambda w: float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w))
            near = sorted((-round(cosine(w), 12), i) for i, w in usable if i != q and len(w) == len(v))[:k]
            out[q] = [i for _, i in near]
    return out


def run(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(4)
    out = {}
    for r in onebit.nearest(frame, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r)
    assert all([r.rank for r in near] == list(range(1, len(near) + 1)) for near in out.values())
    return out


@pytest.mark.parametrize("dims", [3, 64, 100])
def test_recall_and_exact_scores(spark, dims):
    x = vectors(dims, 900, dims)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found, wanted = run(spark, rows, every=20, per_block=17), brute(rows, 5, 20)
    hits = sum(len({r.vec_id for r in found[q]} & set(near)) for q, near in wanted.items())
    assert found.keys() == wanted.keys() and hits / (5 * len(wanted)) >= 0.98
    for q, near in found.items():
        for r in near:
            a, b = x[q].astype(float), x[r.vec_id].astype(float)
            assert r.score == pytest.approx(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b), abs=1e-12)


def test_estimates_stay_inside_their_bounds():
    x = onebit.unit(vectors(1, 3000, 64).astype(float))
    q = onebit.Queries(np.arange(40), x[:40], 5)
    turned = x @ onebit.rotation(64)
    codes = onebit.words(np.packbits(turned >= 0, axis=1))
    estimate, error = q.estimates(codes, np.abs(turned).sum(1) / 8)
    gap = np.abs(estimate - x[:40] @ x.T)
    assert (gap > error).mean() < 1e-3 and np.corrcoef(estimate.ravel(), (x[:40] @ x.T).ravel())[0, 1] > 0.9


def test_bounds_leave_most_vectors_out(monkeypatch):
    x = vectors(2, 4000, 256, kinds=300, spread=0.2).astype(float)
    q = onebit.Queries(np.arange(20), x[:20], 5)
    scored = []
    keep = q._keep
    monkeypatch.setattr(q, "_keep", lambda i, score, ids: (scored.append(len(score)), keep(i, score, ids)))
    turned = onebit.unit(x) @ onebit.rotation(256)
    q.offer(np.arange(4000), onebit.words(np.packbits(turned >= 0, axis=1)), np.abs(turned).sum(1) / 16, onebit.unit(x))
    assert sum(scored) < 0.1 * 20 * 4000


def test_ties_copies_and_rows_that_take_no_part(spark):
    one = [1.0, 2.0, 2.0]
    rows = [(i, one) for i in (0, 9, 3, 7, 5, 1, 2)] + [(50, [2.0, 4.0, 4.0]), (3, one), (100, [1.0, 0.0])]
    rows += [(200, None), (None, one), (150, [0.0, 0.0, 0.0]), (4, [1.0, None, 1.0]), (6, [float("nan"), 1.0, 1.0])]
    rows += [(8, [float("inf"), 0.0, 0.0]), (250, []), (10, [1e-30, 2e-30, 2e-30]), (11, [0.0, 1.0])]
    found = run(spark, rows)
    assert [r.vec_id for r in found[0]] == [1, 2, 3, 5, 7]
    assert all(r.score == pytest.approx(1) for r in found[0])
    assert [r.vec_id for r in found[50]] == [0, 1, 2, 3, 5]
    assert [r.vec_id for r in found[100]] == [11] and found.keys() == {0, 50, 100}


def test_empty_tables_and_no_queries(spark):
    assert run(spark, []) == {} and run(spark, [(1, [1.0]), (2, [2.0])]) == {}
    assert run(spark, [(0, [1.0, 1.0])]) == {}
