"""Centroid clustering in whole numbers, with searches that bounds keep small.

Each vector remembers its centroid, the second-nearest one of its last search, an upper bound on
the distance to the first and a lower bound on that to all others.  Bounds move by what the
centroids moved.  Where they no longer prove the centroid, the exact distances to the two
remembered ones are taken, and the other centroids are scanned in order of their distance from the
closer one.  A centroid farther from it than the vector's distance to it plus that to the second
best is neither of the two nearest, so the scan ends there; every better second shrinks the ball.
Candidates are compared by squared distances in whole numbers, so that ties are exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.llm.exact import LONG, SUMS, add_by_entry, as_cells, cells, collected, finite_vector, floored
from orderflow.llm.exact import long_array, means, rows_of, sum_rows
from orderflow.session import Stage, delete_folder

STATE = "vec_id long, whole array<double>, cluster int, second int, upper double, lower double"
FINAL = "vec_id long, cluster int, distance long"
MORE, LESS = 1 + 1e-12, 1 - 1e-12  # rounding never makes a bound too tight
HUGE = 2**1000  # squares beyond this have no root in doubles


def root_above(squares: np.ndarray) -> np.ndarray:
    """Upper bounds of the square roots."""
    if squares.dtype == object:
        return np.array([math.sqrt(v) * MORE if v < HUGE else math.inf for v in squares], float)
    return np.sqrt(squares.astype(float)) * MORE


def root_below(squares: np.ndarray) -> np.ndarray:
    """Lower bounds of the square roots."""
    if squares.dtype == object:
        return np.array([math.sqrt(min(v, HUGE)) * LESS for v in squares], float)
    return np.sqrt(squares.astype(float)) * LESS


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows, in the rows' own kind of whole numbers."""
    step = x - y
    return (step * step).sum(1) if step.dtype == object else np.einsum("ij,ij->i", step, step)


@dataclass
class Geometry:
    """What a pass needs to know about the centroids; its size is that of their square."""

    centroids: np.ndarray
    order: np.ndarray  # per centroid all others, nearest first
    gaps: np.ndarray  # lower bounds of their distances, in that order
    half: np.ndarray  # a vector nearer to a centroid than this is nearer to no other
    moved: np.ndarray  # how far each centroid went since the last pass, at most
    moved_other: np.ndarray  # the most any other one went

    @classmethod
    def of(cls, centroids: np.ndarray, before: np.ndarray | None) -> Geometry:
        """``centroids`` hold Python's whole numbers here."""
        k = len(centroids)
        between = [[int(((a - b) ** 2).sum()) for b in centroids] for a in centroids]
        order = [sorted((j for j in range(k) if j != i), key=lambda j, i=i: (between[i][j], j)) for i in range(k)]
        gaps = [root_below(np.array([between[i][j] for j in order[i]], object)) for i in range(k)]
        half = np.array([g[0] / 2 if len(g) else math.inf for g in gaps])
        moved = np.zeros(k)
        if before is not None:
            moved = root_above(np.array([int(((a - b) ** 2).sum()) for a, b in zip(centroids, before)], object))
        other = [max([moved[j] for j in range(k) if j != i], default=0.0) for i in range(k)]
        shape = (k, max(k - 1, 0))
        return cls(centroids, np.array(order, int).reshape(shape), np.array(gaps, float).reshape(shape), half, moved, np.array(other))


def search(x: np.ndarray, first: np.ndarray, second: np.ndarray, g: Geometry, d1: np.ndarray, centroids: np.ndarray):
    """The nearest and second-nearest centroids of rows and both squared distances.

    ``first`` and ``second`` are two different centroids to start from.
    """
    d2 = squares(x, centroids[second])
    turned = (d2 < d1) | ((d2 == d1) & (second < first))
    first, second = np.where(turned, second, first), np.where(turned, first, second)
    d1, d2 = np.where(turned, d2, d1), np.where(turned, d1, d2)
    known, start, reach = second.copy(), first.copy(), root_above(d1)
    for c in np.unique(start):
        rows = np.flatnonzero(start == c)
        for j, gap in zip(g.order[c], g.gaps[c]):
            rows = rows[gap <= (reach[rows] + root_above(d2[rows])) * MORE]
            if not len(rows):
                break
            live = rows[known[rows] != j]
            d = squares(x[live], centroids[j])
            best = (d < d1[live]) | ((d == d1[live]) & (j < first[live]))
            better = ~best & (d < d2[live])
            won, close = live[best], live[better]
            second[won], d2[won] = first[won], d1[won]
            first[won], d1[won] = j, d[best]
            second[close], d2[close] = j, d[better]
    return first, second, d1, d2


def assign(x, cluster, second, upper, lower, g: Geometry, centroids: np.ndarray):
    """One pass over rows: bounds first, then a search for those they leave open."""
    if len(centroids) < 2:
        return cluster, second, upper, lower
    upper = (upper + g.moved[cluster]) * MORE
    lower = np.maximum(lower * LESS - g.moved_other[cluster] * MORE, 0)
    # Both bounds are strict: at equality another centroid of a smaller number may win.
    unsure = np.flatnonzero(~(upper < np.maximum(lower, g.half[cluster])))
    d1 = squares(x[unsure], centroids[cluster[unsure]])
    upper[unsure] = root_above(d1)
    still = ~(upper[unsure] < np.maximum(lower, g.half[cluster])[unsure])
    rows = unsure[still]
    a, b, near, next_near = search(x[rows], cluster[rows], second[rows], g, d1[still], centroids)
    cluster[rows], second[rows] = a, b
    upper[rows], lower[rows] = root_above(near), root_below(next_near)
    return cluster, second, upper, lower


def _state(batch: pa.RecordBatch, dims: int, kind: type):
    whole = batch.column(1)
    named = [batch.column(i).to_numpy().copy() for i in range(2, 6)]
    return whole, as_cells(rows_of(whole, dims), kind), named


def first_state(kept: DataFrame, dims: int, scale: int, count: int) -> DataFrame:
    """Whole numbers, and bounds that prove nothing yet."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            flat = pa.array(floored(rows_of(batch.column(1), dims), scale).ravel())
            whole = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dims), flat)
            cells = [np.zeros(n, np.int32), np.full(n, min(1, count - 1), np.int32), np.full(n, np.inf), np.zeros(n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), whole, *map(pa.array, cells)],
                ["vec_id", "whole", "cluster", "second", "upper", "lower"],
            )

    return kept.select("vec_id", "vector").mapInArrow(start, STATE)


def assigned(state: DataFrame, g: Geometry, dims: int, kind: type) -> DataFrame:
    """The state after one pass over all rows."""
    centroids = g.centroids.astype(kind)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, x, named = _state(batch, dims, kind)
            found = assign(x, *named, g, centroids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), whole, *(pa.array(f) for f in found)],
                ["vec_id", "whole", "cluster", "second", "upper", "lower"],
            )

    return state.mapInArrow(step, STATE)


def measured(state: DataFrame, g: Geometry, dims: int, kind: type) -> DataFrame:
    """Each row's centroid after a last pass, and its exact squared distance."""
    centroids = g.centroids.astype(kind)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x, named = _state(batch, dims, kind)
            cluster = assign(x, *named, g, centroids)[0]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cluster), long_array(squares(x, centroids[cluster]))],
                ["vec_id", "cluster", "distance"],
            )

    return state.mapInArrow(step, FINAL)


def centroid_sums(state: DataFrame, count: int, dims: int, most: int, rows: int) -> np.ndarray:
    """Counts and sums of each centroid's vectors."""
    kind = cells(rows * max(most, 1))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((count, dims + 1), kind)
        for batch in batches:
            x = as_cells(rows_of(batch.column(0), dims), kind)
            ones = as_cells(np.ones((len(x), 1)), kind)
            add_by_entry(totals, batch.column(1).to_numpy(), np.concatenate([ones, x], axis=1))
        yield from sum_rows(0, totals)

    return collected(state.select("whole", "cluster").mapInArrow(add, SUMS), (1, count, dims + 1))[0]


def cluster(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    count: int = 40,
    rounds: int = 5,
    dims: int = 64,
    scale: int = 256,
    seed: str = "2",
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per kept vector.

    Kept are vectors with exactly ``dims`` components, none NULL or non-finite (nor beyond the
    doubles once scaled).  A NULL key counts as the empty text in the hash that chooses the first
    centroids; rows that share a key are ordered by vector, and all rows count.  With fewer
    rows than ``count`` each is a centroid; equal centroids are legal, the smaller number wins
    and the other stays as it is.  Distances and inertias too large for a bigint are NULL.
    Other columns, whatever their names, are ignored; an empty table gives an empty result.

    The state of a pass is written before the next one reads it, and the one before is deleted.
    Only centroids, bounded by ``count`` and ``dims``, pass the driver or are broadcast.
    """
    spark, stage = vectors.sparkSession, Stage(vectors.sparkSession)
    kept = vectors.select(
        F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector")
    ).where((F.size("vector") == dims) & finite_vector(F.col("vector"), scale))
    peak = F.max(F.array_max(F.transform("vector", F.abs)))
    rows, peak = kept.agg(F.count(F.lit(1)), peak).first()
    most = int((peak or 0.0) * scale) + 1
    kind = cells(dims * (2 * most) ** 2)

    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = kept.orderBy(F.sha2(name, 256), "vector").select("vector").limit(count).collect()
    k = len(first)
    centroids = as_cells(floored(np.array([r["vector"] for r in first], float).reshape(k, dims), scale), object)

    state, last, before = first_state(kept, dims, scale, k), None, None
    for n in range(rounds if rows else 0):
        state = stage.put(f"pass-{n}", assigned(state, Geometry.of(centroids, before), dims, kind))
        if last is not None:
            delete_folder(spark, last)
        last = stage.path(f"pass-{n}")
        before, centroids = centroids, means(centroids, centroid_sums(state, k, dims, most, rows))
    done = stage.put("clusters", measured(state, Geometry.of(centroids, before), dims, kind))
    if last is not None:
        delete_folder(spark, last)

    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    shas = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    sums = done.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    inertias = {r["cluster"]: r["cluster_inertia"] for r in sums.collect()}
    total = None if None in inertias.values() else sum(inertias.values())
    total = total if total is not None and total < LONG else None
    # A row per centroid: bounded by ``count``.
    told = shas.join(spark.createDataFrame(list(inertias.items()), "cluster int, cluster_inertia long"), "cluster")
    return done.join(F.broadcast(told), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256"
    )
