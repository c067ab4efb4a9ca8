"""Nearest neighbours by cosine with randomly rotated one-bit codes.

Every vector is scaled to length one, turned by a random rotation and kept as the signs of its
coordinates, packed, with one correction scalar: the inner product of the unit vector and its
code.  From code and scalar the inner product with a query is estimated, with a bound on the
error; only vectors whose bound reaches the best found so far are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderflow.llm.common import small_batches
from orderflow.session import Stage

PLANES = 8
BLOCK = 1024
CODED = "vec_id long, dims int, scale double, code binary, vector array<double>"
FOUND = "query_id long, vec_id long, score double"


def rotation(dims: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dims).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows that take part: a key, and a vector of finite numbers that are not all zero."""
    numbers = F.col("vector")
    return (
        vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
        .where(F.col("vec_id").isNotNull() & numbers.isNotNull() & (F.size(numbers) > 0))
        .where(F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        .where(F.exists(numbers, lambda x: x != 0))
    )


def encoded(vectors: DataFrame) -> DataFrame:
    """The index: packed signs of the turned unit vector and the correction scalar, per vector."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_pylist(), batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            for dims in np.unique(sizes):
                rows = np.flatnonzero(sizes == dims)
                kept = lists.take(pa.array(rows))
                x = kept.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dims)
                turned = unit(x) @ rotation(dims)
                signs = turned >= 0
                scale = np.abs(turned).sum(1) / np.sqrt(dims)
                packed = np.packbits(signs, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i] for i in rows], pa.int64()),
                        pa.array(np.full(len(rows), dims, np.int32)),
                        pa.array(scale),
                        pa.array([p.tobytes() for p in packed], pa.binary()),
                        kept,
                    ],
                    ["vec_id", "dims", "scale", "code", "vector"],
                )

    return vectors.mapInArrow(code, CODED)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that large and tiny numbers keep their digits."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Queries:
    """A block of queries of one length, prepared for estimates from packed bits."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.exact = unit(x)
        self.dims = x.shape[1]
        turned = self.exact @ rotation(self.dims)
        # Each coordinate as a whole number of PLANES bits, and each bit plane packed.
        self.low = turned.min(1)
        self.step = np.maximum((turned.max(1) - self.low) / (2**PLANES - 1), 1e-12)
        whole = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.sums = whole.sum(1)
        self.planes = np.stack([words(np.packbits((whole >> b) & 1 == 1, axis=1)) for b in range(PLANES)])
        self.least = np.full(len(ids), -2.0)
        self.best: list[list[tuple[float, int]]] = [[] for _ in ids]

    def estimates(self, codes: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated cosines of all queries with some codes, and bounds on the error.

        With signs s and the query q as low + step * u, sum(s q) needs the sum of u over the set
        bits, which is a popcount per plane.  Dividing by the scalar makes the estimate right on
        average; the bound is the spread of the part of the query that the code does not see,
        times a factor that leaves about one case in ten thousand out, and the rounding's most.
        """
        root = np.sqrt(self.dims)
        inside = np.zeros((len(self.ids), len(codes)), np.int32)
        for b in range(PLANES):
            for j in range(codes.shape[1]):
                inside += np.bitwise_count(self.planes[b, :, j, None] & codes[None, :, j]).astype(np.int32) << b
        ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
        signed = self.step[:, None] * (2 * inside - self.sums[:, None]) + self.low[:, None] * (2 * ones - self.dims)
        spread = np.sqrt(np.maximum(1 - scale**2, 0)) / scale / np.sqrt(max(self.dims - 1, 1))
        rounding = self.step[:, None] * root / 2 / scale
        return signed / root / scale, 3.9 * spread + rounding

    def offer(self, ids: np.ndarray, codes: np.ndarray, scale: np.ndarray, x: np.ndarray) -> None:
        """Compare a block of vectors: estimates for all, exact cosines for those that may be near."""
        for begin in range(0, len(ids), BLOCK):
            part = slice(begin, begin + BLOCK)
            self._offer(ids[part], codes[part], scale[part], x[part])

    def _offer(self, ids: np.ndarray, codes: np.ndarray, scale: np.ndarray, x: np.ndarray) -> None:
        estimate, error = self.estimates(codes, scale)
        estimate[self.ids[:, None] == ids[None, :]] = -np.inf
        # The best estimates first: they raise the bar for the rest.
        take = min(2 * self.k, len(ids))
        top = np.argpartition(-estimate, take - 1, axis=1)[:, :take]
        self._compare(np.repeat(np.arange(len(self.ids)), take), top.ravel(), estimate, error, ids, x)
        np.put_along_axis(estimate, top, -np.inf, axis=1)
        q, c = np.nonzero(estimate + error >= self.least[:, None] - 1e-12)
        for begin in range(0, len(q), 1 << 17):
            some = slice(begin, begin + (1 << 17))
            self._compare(q[some], c[some], estimate, error, ids, x)

    def _compare(
        self, q: np.ndarray, c: np.ndarray, estimate: np.ndarray, error: np.ndarray, ids: np.ndarray, x: np.ndarray
    ) -> None:
        """Exact cosines of pairs of query and vector, in order of queries, that the bound leaves."""
        near = estimate[q, c] + error[q, c] >= self.least[q] - 1e-12
        q, c = q[near], c[near]
        score = np.einsum("ij,ij->i", self.exact[q], x[c])
        near = score >= self.least[q]
        q, c, score = q[near], c[near], score[near]
        begins = np.flatnonzero(np.diff(q, prepend=-1))
        for a, b in zip(begins, [*begins[1:], len(q)]):
            self._keep(q[a], score[a:b], ids[c[a:b]])

    def _keep(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        near = sorted({*self.best[q], *zip((-score).tolist(), ids.tolist())})[: self.k]
        self.best[q] = near
        if len(near) == self.k:
            self.least[q] = -near[-1][0]


def words(packed: np.ndarray) -> np.ndarray:
    """Packed bits as 64-bit words."""
    wide = np.zeros((len(packed), -(-packed.shape[1] // 8) * 8), np.uint8)
    wide[:, : packed.shape[1]] = packed
    return wide.view(np.uint64)


def _scan(index: DataFrame, block: list[tuple[int, list[float]]], seeds: dict, k: int) -> DataFrame:
    """The k nearest of each query of the block in each part of the index."""
    shared = index.sparkSession.sparkContext.broadcast((block, seeds))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seeds = shared.value
        by_dims: dict[int, Queries] = {}
        for dims in {len(v) for _, v in block}:
            rows = [(i, v) for i, v in block if len(v) == dims]
            found = Queries(np.array([i for i, _ in rows]), np.array([v for _, v in rows]), k)
            found.least = np.array([seeds.get(i, -2.0) for i, _ in rows])
            by_dims[dims] = found
        for batch in batches:
            sizes = np.array(batch.column(1))
            for dims in np.unique(sizes):
                if dims not in by_dims:
                    continue
                rows = pa.array(np.flatnonzero(sizes == dims))
                ids, scale = (batch.column(i).take(rows).to_numpy(zero_copy_only=False) for i in (0, 2))
                packed = np.frombuffer(b"".join(batch.column(3).take(rows).to_pylist()), np.uint8).reshape(len(rows), -1)
                x = batch.column(4).take(rows).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dims)
                by_dims[dims].offer(ids, words(packed), scale, unit(x))
        out = [(int(q.ids[i]), v, -s) for q in by_dims.values() for i, near in enumerate(q.best) for s, v in near]
        columns = list(zip(*out)) or [[], [], []]
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["query_id", "vec_id", "score"])

    return index.mapInArrow(scan, FOUND)


def nearest(
    vectors: DataFrame,
    k: int = 5,
    every: int = 50,
    key: str = "vec_id",
    vector: str = "embedding",
    per_block: int = 2048,
    seed_rows: int = 1024,
) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of every query, ties to smaller ids.

    Queries are the rows whose key is divisible by ``every``; all other rows are compared with
    them, each but the query's own key.  Vectors of different lengths are never compared.  Rows
    that cannot take part (no key, or a vector that is NULL, empty, zero or holds NULL or
    numbers that are not finite) are neither.  If a query's key repeats, its smallest vector
    asks; rows of other repeated keys count once per key and score.

    The index is written once.  Queries are taken in blocks of bounded size, each broadcast and
    answered in one pass over the index in which a part returns its k best per query; a bounded
    number of rows gives every query a first bar, so that parts without near vectors return
    little.  The work is queries times codes, a popcount per bit plane each.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    stage = Stage(spark)
    index = stage.put("index", encoded(usable(vectors, key, vector)))
    asking = index.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asking = stage.put("asking", asking.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(_blocks(asking, per_block)))))
    first = index.limit(seed_rows).collect()
    answers = None
    for block in range(_blocks(asking, per_block)):
        rows = [(r.vec_id, r.vector) for r in asking.where(F.col("block") == block).collect()]
        if rows:
            found = _scan(index, rows, _bars(rows, first, k), k)
            answers = found if answers is None else answers.unionByName(found)
    if answers is None:
        answers = spark.createDataFrame([], FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        answers.distinct()
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def _blocks(asking: DataFrame, per_block: int) -> int:
    return max(1, -(-asking.count() // per_block))


def _bars(rows: list[tuple[int, list[float]]], first: list, k: int) -> dict[int, float]:
    """For each query the k-th best cosine among a few vectors: no worse one can be needed."""
    bars = {}
    for dims in {len(v) for _, v in rows}:
        ids = np.array([r.vec_id for r in first if r.dims == dims])
        if len(set(ids.tolist())) <= k:
            continue
        _, once = np.unique(ids, return_index=True)
        x = unit(np.array([r.vector for r in first if r.dims == dims])[once])
        for i, v in rows:
            if len(v) == dims:
                scores = (x * unit(np.array([v]))).sum(1)[ids[once] != i]
                bars[i] = float(np.sort(scores)[-k]) - 1e-12
    return bars
