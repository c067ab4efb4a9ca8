"""Product-quantised codes of vectors, assigned over a trie of distinct parts.

A vector's whole numbers are cut into equal parts, each coded by the nearest entry of its
position's codebook.  The distinct parts of all vectors are sorted once; sorted parts are the
leaves of a trie over their components.  A depth-first traversal keeps, for each node on its path,
the distances of all entries over the components so far, so that parts with a common prefix share
that work; a leaf takes the nearest entry and adds itself, times its number of copies, to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.llm.exact import add_by_entry, as_cells, cells, collected, finite_vector, floored, long_array
from orderflow.llm.exact import SUMS, means, rows_of, sum_rows
from orderflow.session import Stage

LEAVES = 512  # a block of leaves whose distance vectors are held at once
TASK_BYTES = 64 << 20
PARTS = "position int, part array<double>, n long"


def sorted_rows(x: np.ndarray) -> np.ndarray:
    """The order of the rows by their components, first component first."""
    return np.lexsort(x.T[::-1]) if x.shape[1] else np.arange(len(x))


def shared_prefixes(x: np.ndarray, before: np.ndarray | None) -> np.ndarray:
    """How many leading components each row has in common with the row before it."""
    out = np.zeros(len(x), np.int64)
    out[1:] = np.logical_and.accumulate(x[1:] == x[:-1], axis=1).sum(1)
    if before is not None and len(x):
        out[0] = np.logical_and.accumulate(x[0] == before).sum()
    return out


class Walk:
    """A depth-first traversal of the trie of sorted parts, a block of leaves at a time.

    The path to the last leaf is kept with its accumulated distances, so a prefix that goes on
    in the next block is not computed again.  Any order of rows gives right results; sorted rows
    share most.
    """

    def __init__(self, book: np.ndarray):
        self.book, self.last = book, None
        self.path = [np.zeros(len(book), book.dtype) for _ in range(book.shape[1] + 1)]

    def leaves(self, x: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Per block: its rows, each one's nearest entry (ties: the lower) and squared distance."""
        for begin in range(0, len(x), LEAVES):
            block = x[begin : begin + LEAVES]
            common = shared_prefixes(block, self.last)
            reached, owner = self.path[0][None], np.zeros(len(block), np.int64)
            for depth in range(x.shape[1]):
                opens = common <= depth
                step = block[opens, depth][:, None] - self.book[:, depth]
                grown = reached[owner[opens]] + step * step
                if not opens[0]:
                    grown = np.concatenate([self.path[depth + 1][None], grown])
                reached, owner = grown, np.cumsum(opens) - int(opens[0])
                self.path[depth + 1] = reached[-1].copy()
            self.last = block[-1]
            nearest = np.argmin(reached, axis=1)
            least = reached[np.arange(len(reached)), nearest]
            yield slice(begin, begin + len(block)), nearest[owner], least[owner]


def kept_vectors(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Rows whose vector takes part, under names of their own."""
    return vectors.select(
        F.col(f"`{key}`").cast("long").alias("vec_id"),
        F.col(f"`{label}`").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"),
    ).where(finite_vector(F.col("vector"), 2**10))


def distinct_parts(kept: DataFrame, width: int, scale: int, positions: int, tasks: int, stage: Stage) -> DataFrame:
    """(position, part, n): parts reduced to distinct ones in each batch, then sorted over all tasks.

    A part that many rows hold leaves a batch as one row, so no range is made large by copies.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = floored(rows_of(batch.column(0), width * positions), scale)
            for position in range(positions):
                x = whole[:, position * width : (position + 1) * width]
                x = x[sorted_rows(x)]
                first = np.flatnonzero(shared_prefixes(x, None) < max(width, 1)) if width else np.arange(min(len(x), 1))
                n = np.diff([*first, len(x)])
                flat = pa.array(x[first].ravel())
                ends = pa.array(np.arange(len(first) + 1, dtype=np.int32) * width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), position, np.int32)), pa.ListArray.from_arrays(ends, flat), pa.array(n)],
                    ["position", "part", "n"],
                )

    rows = kept.select("vector").mapInArrow(cut, PARTS)
    return stage.put("parts", rows.repartitionByRange(tasks, "position", "part").sortWithinPartitions("position", "part"))


def entry_sums(parts: DataFrame, books: np.ndarray, most: int, rows: int) -> np.ndarray:
    """Counts and weighted sums of the parts nearest to each entry, by position and entry."""
    positions, entries, width = books.shape
    near, wide = cells(width * (2 * most) ** 2), cells(rows * max(most, 1))
    books = books.astype(near)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = [Walk(book) for book in books]
        totals = np.zeros((positions, entries, width + 1), wide)
        for batch in batches:
            position, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            x = as_cells(rows_of(batch.column(1), width), near)
            for p in np.unique(position):
                mine = np.flatnonzero(position == p)
                for block, entry, _ in walks[p].leaves(x[mine]):
                    at = mine[block]
                    weight = as_cells(n[at], wide)[:, None]
                    weighed = np.concatenate([weight, x[at].astype(wide) * weight], axis=1)
                    add_by_entry(totals[p], entry, weighed)
        for p in range(positions):
            yield from sum_rows(p, totals[p])

    return collected(parts.mapInArrow(walk, SUMS), (positions, entries, width + 1))


def coded(kept: DataFrame, books: np.ndarray, most: int, scale: int) -> DataFrame:
    """Every kept row with its code and error; NULL for vectors of another length than the books'."""
    positions, _, width = books.shape
    near = cells(positions * width * (2 * most) ** 2)
    books = books.astype(near)
    label = kept.schema["label"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            fits = np.flatnonzero(np.diff(lists.offsets.to_numpy()) == positions * width)
            x = as_cells(floored(rows_of(lists.take(pa.array(fits)), positions * width), scale), near)
            codes = np.zeros((len(fits), positions), np.int64)
            error = np.zeros(len(fits), near if near is object else np.int64)
            for position, book in enumerate(books):
                part = x[:, position * width : (position + 1) * width]
                order = sorted_rows(part)
                for block, entry, distance in Walk(book).leaves(part[order]):
                    codes[order[block], position] = entry
                    error[order[block]] += distance
            at = pa.array(_places(fits, batch.num_rows), pa.int64())
            text = pa.array(["".join(f"{c:02x}" for c in row) for row in codes.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), text.take(at), long_array(error).take(at)],
                ["vec_id", "label", "code", "error"],
            )

    return kept.mapInArrow(code, f"vec_id long, label {label}, code string, error long")


def _places(fits: np.ndarray, rows: int) -> list[int | None]:
    """For each row its place among those that fit, or None."""
    out: list[int | None] = [None] * rows
    for place, row in enumerate(fits.tolist()):
        out[row] = place
    return out


def hashed(books: np.ndarray) -> str:
    """sha256 of all components in order of position, entry and place, as decimals with commas."""
    return hashlib.sha256(",".join(str(int(v)) for v in books.flat).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positions: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) per vector that takes part.

    NULL vectors and vectors with a NULL or non-finite component are dropped; so are components
    whose ``scale``-fold is beyond the doubles.  NULL keys stay and sort behind all others for
    the first codebook; repeated keys and rows are ordered by vector and all count.  The
    codebooks are for the most common length that ``positions`` divides (ties: the longer);
    vectors of other lengths, empty ones among them, keep their row with NULL as code and error,
    and add nothing.  With fewer rows than ``entries`` each row is an entry.  An error too large
    for a bigint is NULL.  Other columns, whatever their names, are ignored; an empty table
    gives an empty result.

    Copies of a vector are merged before the parts are range-sorted; the codebooks, bounded by
    their shape, are all that passes the driver.  Distances and sums are whole numbers
    throughout, so nothing depends on partitioning.
    """
    spark, stage = vectors.sparkSession, Stage(vectors.sparkSession)
    kept = kept_vectors(vectors, key, vector, label)
    length = F.size("vector")
    sizes = kept.where((length > 0) & (length % positions == 0)).groupBy(length.alias("dims"))
    peak = F.max(F.array_max(F.transform("vector", F.abs)))
    found = sizes.agg(F.count(F.lit(1)).alias("n"), peak.alias("peak")).orderBy(F.desc("n"), F.desc("dims")).first()
    dims, rows, peak = (found["dims"], found["n"], found["peak"]) if found else (positions, 0, 0.0)
    width, most = dims // positions, int(peak * scale) + 1
    fitting = kept.where(length == dims)

    first = fitting.orderBy(F.asc_nulls_last("vec_id"), "vector").select("vector").limit(entries).collect()
    whole = as_cells(floored(np.array([r["vector"] for r in first], float).reshape(len(first), dims), scale), object)
    books = np.ascontiguousarray(whole.reshape(len(first), positions, width).transpose(1, 0, 2))
    if rows:
        tasks = max(_tasks(spark), rows * dims * 8 // TASK_BYTES)
        parts = distinct_parts(fitting, width, scale, positions, tasks, stage)
        for _ in range(rounds):
            totals = entry_sums(parts, books, most, rows)
            books = np.stack([means(book, total) for book, total in zip(books, totals)])

    done = stage.put("coded", coded(kept, books, most, scale))
    by_label = done.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    return (
        done.alias("d")
        .join(by_label.alias("l"), F.col("d.label").eqNullSafe(F.col("l.label")))
        .select("d.*", "l.label_error", F.lit(hashed(books)).alias("codebooks_sha256"))
    )


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
