"""Whole-number arithmetic for vectors: cells wide enough for a bound, sums no task can overflow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG = 2**63
LIMB = 32
SUMS = "part int, entry int, slot int, limb int, value long"


def cells(bound: int) -> type:
    """The narrowest kind of cell that holds whole numbers up to ``bound`` exactly."""
    return np.int32 if bound < 2**31 else np.int64 if bound < LONG else object


def as_cells(x: np.ndarray, kind: type) -> np.ndarray:
    """Floating whole numbers as whole numbers of a kind; ``object`` cells are Python's own."""
    if kind is not object:
        return x.astype(kind)
    out = np.empty(x.shape, object)
    out.flat = [int(v) for v in x.flat]
    return out


def floored(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) for a power of two, exact in floating cells; zero has no sign."""
    return np.floor(x * float(scale)) + 0.0


def finite_vector(vector: Column, scale: int) -> Column:
    """Neither NULL nor with a component that is NULL or whose ``scale``-fold is not finite."""
    most = 2.0**1023 / scale
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < most))


def rows_of(lists: pa.ListArray, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)


def long_array(values: np.ndarray) -> pa.Array:
    """As bigints; what is too large for one is NULL."""
    if values.dtype != object:
        return pa.array(values.astype(np.int64))
    return pa.array([int(v) if v < LONG else None for v in values], pa.int64())


def add_by_entry(totals: np.ndarray, entries: np.ndarray, rows: np.ndarray) -> None:
    """totals[e] += the sum of the rows of entry e, exact in the totals' kind of cell."""
    order = np.argsort(entries, kind="stable")
    named, first = np.unique(entries[order], return_index=True)
    if len(named):
        totals[named] += np.add.reduceat(rows[order], first, axis=0)


def sum_rows(part: int, totals: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The totals that are not zero, as rows of SUMS.  Wide numbers are cut into limbs."""
    entry, slot = np.nonzero(totals != 0)
    value = totals[entry, slot]
    limb = np.zeros(len(value), np.int32)
    if totals.dtype == object:
        found = [list(limbs(int(v))) for v in value]
        counts = [len(f) for f in found]
        entry, slot = np.repeat(entry, counts), np.repeat(slot, counts)
        limb = np.array([i for f in found for i in range(len(f))], np.int32)
        value = np.array([v for f in found for v in f], np.int64)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(value), part, np.int32)),
            pa.array(entry.astype(np.int32)),
            pa.array(slot.astype(np.int32)),
            pa.array(limb),
            pa.array(value.astype(np.int64)),
        ],
        ["part", "entry", "slot", "limb", "value"],
    )


def limbs(value: int) -> Iterator[int]:
    """Signed pieces of 32 bits, lowest first, that add up to the value."""
    sign, value = (-1, -value) if value < 0 else (1, value)
    while value:
        yield sign * (value & (2**LIMB - 1))
        value >>= LIMB


def collected(sums: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """Totals over all tasks as Python's whole numbers, by part, entry and slot.

    The rows that reach the driver are bounded by the shape, which does not grow with the data.
    """
    out = np.zeros(shape, object)
    summed = sums.groupBy("part", "entry", "slot", "limb").agg(F.sum("value").alias("value"))
    for part, entry, slot, limb, value in summed.collect():
        out[part, entry, slot] += value << (LIMB * limb)
    return out


def means(old: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Entries replaced by floor(sum / count); slot 0 counts, an unused entry stays."""
    return np.array(
        [[v // row[0] for v in row[1:]] if row[0] else list(kept) for kept, row in zip(old, totals)], object
    ).reshape(old.shape)
