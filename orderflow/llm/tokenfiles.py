"""Token ids as Parquet list columns that can be read in part.

Documents are put in key order, tokenised where they lie and written with dictionary-coded
token ids, delta-coded sorted integers, bounded row groups and page indexes, so that a reader
of a key range or of the counts alone touches only those pages.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from threading import Timer

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderflow.llm.common import give_back, slices, small_batches, text_of

# Parquet settings by column: ids repeat and take a dictionary; sorted whole numbers take deltas.
OWN = frozenset("part place tokens n_tokens ids_crc32 start _text _offset _inside _all".split())
LAYOUT = {
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#tokens.list.element": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "compression": "zstd",
}
CACHED, CACHE_BYTES = 500_000, 96 << 20  # words, and bytes of them
IDLE_SECONDS = 5.0
MARKS = string.punctuation
WORD = re.compile(r" ?\S+").fullmatch
PLAIN = re.compile(r" ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u02AF]+").fullmatch


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write each byte: visible ones as themselves, the rest from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class OddPiece(Exception):
    """A piece that is no word, so its text has to be encoded whole."""


class Words(dict):
    """Little-endian ids of words, each with the space before it if there is one; bounded.

    Once half the bound is reached these words become the earlier ones, and those go that were.
    A word met again in time moves up, so common words are never encoded anew and rare ones pass.
    The byte-level splitter makes one piece of letters and one of the marks behind them, so a
    stem's ids are looked up for the next word with that stem, and a piece of plain letters
    goes to the merge model alone.  All other words pass the whole tokenizer.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.merges, self.letters, self.held = tokenizer, tokenizer.model.tokenize, byte_letters(), 0
        self.space, self.timer, self.earlier = self.letters[ord(" ")], None, {}

    def forget(self) -> None:
        self.clear()
        self.earlier, self.held = {}, 0

    def drop(self) -> None:
        self.forget()
        give_back()

    def wanted(self, now: bool) -> None:
        """Keep the words while tasks follow each other; drop them once the worker does other work."""
        if self.timer:
            self.timer.cancel()
        self.timer = None if now else Timer(IDLE_SECONDS, self.drop)
        if self.timer:
            self.timer.daemon = True
            self.timer.start()

    def whole(self, text: str) -> bytes:
        found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        return array("I", found.ids).tobytes()

    def encoded(self, word: str) -> bytes:
        if PLAIN(word):
            # ASCII letters are written as themselves, and the space as one other letter.
            written = word.replace(" ", self.space) if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            found = self.merges(written)
            return array("I", [t.id for t in found]).tobytes()
        if not WORD(word):
            raise OddPiece
        stem = word.rstrip(MARKS)
        return self[stem] + self[word[len(stem) :]] if stem != word and PLAIN(stem) else self.whole(word)

    def __missing__(self, word: str) -> bytes:
        ids = self.earlier.pop(word, None) or self.encoded(word)
        if len(self) > CACHED // 2 or self.held > CACHE_BYTES // 2:
            earlier = self.copy()
            self.forget()
            self.earlier = earlier
        self.held += len(word) + len(ids) + 180  # what Python adds to both
        self[word] = ids
        return ids


class Encoder:
    """A tokenizer that cuts texts at single spaces and line ends, where it always cuts itself.

    Texts with any other white space, or that hold a special token, are encoded whole.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_file(path)
        self.special = ["\0", *(t.content for t in tokenizer.get_added_tokens_decoder().values())]
        self.end = array("I", [end_id]).tobytes()
        self.known = Words(tokenizer)
        self.line = self.known.whole("\n")

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, with the end id."""
        return [self._text(t) + self.end for t in texts]

    def _text(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.known.whole(text)
        known, lines = self.known.__getitem__, text.split("\n")
        try:
            # A mark before each space keeps it with the word behind it.
            return self.line.join([b"".join(map(known, x.replace(" ", "\0 ").split("\0"))) for x in lines])
        except OddPiece:
            return self.known.whole(text)


ENCODERS: list[Encoder] = []


@cache
def encoder(path: str, end_id: int) -> Encoder:
    """One per Python worker, so that its words outlast a task."""
    ENCODERS.append(Encoder(path, end_id))
    return ENCODERS[-1]


def forget_words() -> None:
    """Drop the words at once, for steps of the same worker that encode nothing."""
    for found in ENCODERS:
        found.known.wanted(now=True)
        found.known.drop()


def key_name(key: str) -> str:
    """The key's name in the files: underscores go before one that the files or their readers use themselves."""
    while key.lower() in OWN:
        key = f"_{key}"
    return key


def tokenized(docs: DataFrame, path: str, end_id: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Key, part, place in the part and token ids; parts and places follow the key order."""
    name = key_name(key)
    schema = f"`{name}` {docs.schema[key].dataType.simpleString()}, part int, place long, tokens array<int>, n_tokens int"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place, ids_of = TaskContext.get().partitionId(), 0, encoder(path, end_id)
        ids_of.known.wanted(now=True)
        for batch in slices(batches, "_text", 3 << 20):
            ids = ids_of(batch.column(1).to_pylist())
            sizes = np.array([len(x) // 4 for x in ids], np.int32)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(ids), "<i4"))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n)), tokens, pa.array(sizes)],
                [name, "part", "place", "tokens", "n_tokens"],
            )
            place += n
        ids_of.known.wanted(now=False)

    small_batches(docs.sparkSession, 2000)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{key}`").alias(name), text_of(text).alias("_text"))
    return (
        rows.repartitionByRange(parts, name)
        .sortWithinPartitions(name, "_text")
        .mapInArrow(encode, schema)
    )


def write_tokens(docs: DataFrame, folder: str, path: str, **options) -> None:
    """Write ``docs`` in key order; ``folder`` then holds a file or more per part.

    NULL texts hold the end id alone, NULL keys come first, equal keys are ordered by text,
    repeated rows are written each; texts of any length are encoded whole.  Columns other than
    key and text are not written.  An empty table writes an empty file.
    """
    writer = tokenized(docs, path, **options).write.mode("overwrite")
    for name, value in LAYOUT.items():
        writer = writer.option(name, value)
    writer.parquet(folder)


def read_tokens(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The files; with columns named, only those are read."""
    frame = spark.read.parquet(folder)
    return frame.select(*columns) if columns else frame


def with_starts(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """The files' documents with ``start``: the ids of all documents before.

    Parts are totalled from two narrow columns; the running sum inside a part is the only
    other step, so no task holds more than a part.
    """
    parts = read_tokens(spark, folder, "part", "n_tokens").groupBy("part").agg(F.sum("n_tokens").alias("_all"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return (
        digests(spark, folder, key)
        .withColumn("_inside", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
        .join(F.broadcast(offsets), "part")
        .withColumn("start", F.col("_offset") + F.col("_inside"))
        .drop("_offset", "_inside")
    )


def digests(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """Per document of the files: key, part, place, n_tokens and the crc32 of its ids."""
    key = key_name(key)
    frame = read_tokens(spark, folder, key, "part", "place", "tokens")
    schema = f"`{key}` {frame.schema[key].dataType.simpleString()}, part int, place long, n_tokens long, ids_crc32 long"

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        for batch in batches:
            tokens = batch.column(3)
            ends = tokens.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(tokens.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())],
                [key, "part", "place", "n_tokens", "ids_crc32"],
            )
        batch = tokens = raw = None  # else their memory counts as used
        give_back()

    return frame.mapInArrow(crc, schema)
