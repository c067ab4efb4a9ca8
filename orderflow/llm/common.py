"""Small helpers the operators of this package share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
# Bytes of text that are hashed word by word at once; it takes some 40 times as much memory.
SLICE = 512 << 10


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, with NULL as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_count(column: str | Column) -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def hash_text(*columns: str | Column, length: int = 16) -> Column:
    """The first hex digits of an md5 over the columns, the same in every engine."""
    parts = [text_of((F.col(c) if isinstance(c, str) else c).cast("string")) for c in columns]
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, length)


def doc_crc(column: str | Column) -> Column:
    """Unsigned crc32 of the id written as text; NULL counts as the empty text."""
    return F.crc32(text_of((F.col(column) if isinstance(column, str) else column).cast("string")))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns an operator is about to add, whatever their case."""
    wanted = {n.lower() for n in names}
    return df.select(*(f"`{c}`" for c in df.columns if c.lower() not in wanted))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Batches of texts that a Python worker holds at once; a limit somebody set is kept."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if name not in dict(spark.sparkContext.getConf().getAll()):
        spark.conf.set(name, str(rows))


def slices(batches: Iterator[pa.RecordBatch], text: str | int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``most`` bytes of text, or one row.

    Behind the last one the worker gives back memory it no longer uses.
    """
    for batch in batches:
        start, held = 0, 0
        for row, size in enumerate(pc.binary_length(batch.column(text)).to_pylist()):
            if held and held + (size or 0) > most:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size or 0
        if start < batch.num_rows:
            yield batch.slice(start)
    batch = None  # else its memory counts as used
    give_back()


@cache
def _trim():
    """What makes the C library give back free memory; nothing where it offers none."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return lambda pad: 0


def give_back() -> None:
    """Return free memory to the system.

    Arrow and the C library keep what they freed, in each worker as much as its largest task
    took; workers outlast their tasks and stand beside the executor's JVM.
    """
    pa.default_memory_pool().release_unused()
    _trim()(0)


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


PLACES = np.random.default_rng(20).integers(1, 2**63, 256, np.uint64) | np.uint64(1)
IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20


def hashed_words(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, A-Z lower-cased, and each text's first word.

    The second array has one entry more than there are texts.
    """
    raw = [(t or "").encode() for t in texts]
    data = FOLD[np.frombuffer(b" ".join([*raw, b""]) or b" ", np.uint8)]
    space = IS_SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    starts = np.flatnonzero(begins)
    edges = np.cumsum([0, *(len(r) + 1 for r in raw)])
    first = np.searchsorted(starts, edges)
    if not len(starts):
        return np.empty(0, np.uint64), first
    lead = np.zeros(starts[0], np.int64)
    place = np.arange(len(data)) - np.concatenate([lead, np.repeat(starts, np.diff([*starts, len(data)]))])
    weight = PLACES[place & 255] * ((place >> 8).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    sums = np.where(space, np.uint64(0), (data.astype(np.uint64) + np.uint64(1)) * weight)
    return mixed_bits(np.add.reduceat(sums, starts)), first


def set_aside(df: DataFrame, *used: str) -> tuple[DataFrame, dict[str, str]]:
    """The columns of ``df`` under names no operator uses itself, but for ``used``; and each one's new name.

    Renaming moves no data.  ``given_back`` undoes it.
    """
    kept = {u.lower() for u in used}
    names = {c: c if c.lower() in kept else f"given_{i}" for i, c in enumerate(df.columns)}
    return df.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), names


def new_name(names: dict[str, str], column: str) -> str:
    """What ``set_aside`` made of the column, whatever its case."""
    return next(n for c, n in names.items() if c.lower() == column.lower())


def given_back(names: dict[str, str]) -> list[Column]:
    return [F.col(f"`{n}`").alias(c) for c, n in names.items()]


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
