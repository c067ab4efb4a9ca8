"""Class-based bigram language model in the manner of Brown, by exchange clustering.

P(word | previous) = P(class | previous class) x P(word | class), both smoothed so that all
words, and one unknown word per class, sum to one.

All words have a class.  The core of the clustering moves units: each frequent word is one, and
all other words that share a hash of their ending are one together, so the table of unit
bigrams has a fixed size while every bigram of the training texts is in it.  Then every other word
that occurs often enough moves to its own best class, by its counts of neighbouring classes, in
Spark's tasks; their number grows with the texts, and only the rarest words stay with their ending.
The transitions are counted anew from the classes words have in the end.  Classes and counts of
the most frequent words travel to the tasks as a table of bounded size; those of all others are
joined by word.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.llm.common import doc_crc, slices, small_batches, text_of
from orderflow.session import Stage

UNLISTED = 255  # stands in a line of classes for a word whose class is joined

LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))


def tokens(text: str) -> list[bytes]:
    """Words with A-Z lower-cased; bytes.split() parts at exactly the six ASCII spaces."""
    return text.encode().translate(LOWER).split()


def family(word: bytes, families: int) -> int:
    """The unit of a word that is not frequent, by its ending."""
    return zlib.crc32(word[-3:]) % families


def word_counts(texts: DataFrame, families: int, most: int = 300_000) -> DataFrame:
    """(word, family, n) over all words of the column ``_text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            kinds = [family(w, families) for w in held]
            words = pa.array(list(held), pa.binary()).cast(pa.string())
            rows = [words, pa.array(kinds, pa.int32()), pa.array(list(held.values()), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(rows, ["word", "family", "n"])

        for batch in slices(batches, "_text"):
            for text in batch.column("_text").to_pylist():
                held.update(tokens(text))
            if len(held) > most:
                yield flushed()
        if held:
            yield flushed()

    partial = texts.select("_text").mapInArrow(count, "word string, family int, n long")
    return partial.groupBy("word", "family").agg(F.sum("n").alias("n"))


def unit_bigrams(texts: DataFrame, frequent: list[bytes], families: int, block: int = 64) -> np.ndarray:
    """Counts of neighbouring units; the last unit is the end, which also starts a text."""
    end = len(frequent) + families
    size = end + 1
    shared = texts.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(frequent)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, base = shared.value, len(shared.value)
        sums = np.zeros(size * size, np.int64)
        for batch in slices(batches, "_text", 4 << 20):
            flat: list[int] = [end]
            for text in batch.column("_text").to_pylist():
                words = tokens(text)
                ids = list(map(known.get, words, repeat(-1)))
                flat.extend(i if i >= 0 else base + family(w, families) for i, w in zip(ids, words))
                flat.append(end)
            line = np.array(flat, np.int64)
            sums += np.bincount(line[:-1] * size + line[1:], minlength=size * size)
        found = np.flatnonzero(sums)
        edges = np.searchsorted(found, np.arange(0, size + block, block) * size)
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            if b > a:
                cells = (found[a:b] - k * block * size).astype(np.uint32).tobytes()
                row = [pa.array([k], pa.int32()), pa.array([cells]), pa.array([sums[found[a:b]].tobytes()])]
                yield pa.RecordBatch.from_arrays(row, ["block", "cells", "counts"])

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros(block * size, np.int64)
        for cells, counts in zip(rows.cells, rows.counts):
            sums[np.frombuffer(cells, np.uint32)] += np.frombuffer(counts, np.int64)
        return pd.DataFrame({"block": rows.block[:1], "counts": [sums.tobytes()]})

    partial = texts.select("_text").mapInArrow(count, "block int, cells binary, counts binary")
    whole = np.zeros((-(-size // block) * block, size), np.int64)
    # Blocks are few and of one size: the table is (frequent + families + 1) squared.
    for row in partial.groupBy("block").applyInPandas(total, "block int, counts binary").collect():
        whole[row.block * block : (row.block + 1) * block] = np.frombuffer(row.counts, np.int64).reshape(block, size)
    return whole[:size]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int | None = None) -> np.ndarray:
    """The class of every unit; the last unit, the end, keeps class 0 to itself.

    Units start dealt out by frequency.  Each in turn moves to the class that gives the
    training bigrams the highest likelihood, until a sweep moves none (or after ``sweeps``).
    Each move makes the likelihood greater, so the sweeps end.
    """
    n = bigrams.astype(np.float64)
    size = len(n)
    counts = n.sum(1)
    order = np.argsort(-counts[:-1], kind="stable")
    label = np.zeros(size, np.int64)
    label[order] = 1 + np.arange(size - 1) % (classes - 1)
    member = np.eye(classes)[label]
    table = member.T @ n @ member
    for _ in count() if sweeps is None else range(sweeps):
        moved = 0
        for w in order:
            if not counts[w]:
                continue
            own, self_pair = label[w], n[w, w]
            right = np.bincount(label, n[w], classes)
            left = np.bincount(label, n[:, w], classes)
            right[own] -= self_pair
            left[own] -= self_pair
            table[own] -= right
            table[:, own] -= left
            table[own, own] -= self_pair
            gain = (_xlogx(table + right) - _xlogx(table)).sum(1) + (_xlogx(table + left[:, None]) - _xlogx(table)).sum(0)
            at = np.diag(table)
            gain += _xlogx(at + left + right + self_pair) + _xlogx(at) - _xlogx(at + right) - _xlogx(at + left)
            begun, ended = table.sum(1), table.sum(0)
            gain -= _xlogx(begun + counts[w]) - _xlogx(begun) + _xlogx(ended + counts[w]) - _xlogx(ended)
            gain[0] = -np.inf
            best = int(np.argmax(gain))
            best = own if gain[best] <= gain[own] + 1e-9 else best
            table[best] += right
            table[:, best] += left
            table[best, best] += self_pair
            label[w] = best
            moved += best != own
        if not moved:
            break
    return label


@dataclass
class Model:
    """The model of the units; ``words`` and ``counts`` are the listed words."""

    words: list[bytes]
    counts: np.ndarray
    frequent: int
    families: int
    unit_class: np.ndarray
    transitions: np.ndarray
    emission: np.ndarray
    ends: int
    total: int
    distinct: int


def _numbered(words: list[bytes], frequent: int, families: int) -> np.ndarray:
    """The unit of each listed word."""
    return np.array([i if i < frequent else frequent + family(w, families) for i, w in enumerate(words)], np.int64)


def _least_listed(counts: DataFrame, listed: int) -> int:
    """The least count that at most ``listed`` words have, from a table of a few hundred sizes."""
    step = F.floor(F.log2("n") * 32)
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("n")).orderBy(F.desc("step"))
    least, so_far = 2**63 - 1, 0
    for row in sizes.collect():
        so_far += row.words
        if so_far > listed:
            break
        least = row.n
    return least


def fit(
    counts: DataFrame, texts: DataFrame, frequent: int, families: int, classes: int, listed: int, alpha: float = 0.5
) -> Model:
    top = sorted(counts.where(F.col("n") >= _least_listed(counts, listed)).select("word", "n").collect(), key=lambda r: (-r.n, r.word))
    words, known = [r.word.encode() for r in top], np.array([r.n for r in top], np.int64)
    frequent = min(frequent, len(words))
    sums = counts.agg(F.sum("n"), F.count("*")).first()
    ends = texts.count()
    bigrams = unit_bigrams(texts, words[:frequent], families)
    label = exchange(bigrams, classes)
    # Distinct words by unit: a family has the words of its ending less the frequent ones.
    distinct = np.zeros(len(label), np.int64)
    for row in counts.groupBy("family").agg(F.count("*").alias("k")).collect():
        distinct[frequent + row.family] = row.k
    for w in words[:frequent]:
        distinct[frequent + family(w, families)] -= 1
    distinct[:frequent] = 1
    distinct[-1] = ends > 0
    member = np.eye(classes)[label]
    table = member.T @ bigrams @ member
    transitions = np.log10((table + alpha) / (table.sum(1, keepdims=True) + alpha * classes))
    # Occurrences as successors: the words of a class in the training texts.
    emission = np.log10(table.sum(0) + np.bincount(label, distinct, classes) + 1)
    total, kinds = (sums[0] or 0) + ends, sums[1] + (ends > 0)
    return Model(words, known, frequent, families, label, transitions, emission, ends, total, kinds)


def _hopeful(counts: DataFrame, enough: int, width: int = 26) -> np.ndarray:
    """Bits: those of crc32 mod 2^width of the words with ``enough`` occurrences are set; 8 MB at any size of the input."""
    bit = F.pmod(F.crc32("word"), F.lit(1 << width))
    lines = counts.where(F.col("n") >= enough).groupBy(F.shiftright(bit, 6).alias("line"))
    found = lines.agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(crc32(word), {1 << width}) & 63 AS INT))")).alias("bits")).toArrow()
    bits = np.zeros(1 << width >> 6, np.int64)
    bits[found["line"].to_numpy()] = found["bits"].to_numpy()
    return np.unpackbits(bits.view(np.uint8), bitorder="little").view(bool)


class _Seen(dict):
    """Words of a task: class, plus the word's place times ``STEP`` if its neighbours are counted."""

    STEP = 256

    def __init__(self, core: dict[bytes, int], family_class: np.ndarray, bits: np.ndarray):
        super().__init__(core)
        self.family_class, self.bits = family_class.tolist(), bits
        self.names: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        code = self.family_class[family(word, len(self.family_class))]
        if self.bits[zlib.crc32(word) % len(self.bits)]:
            self.names.append(word)
            code += len(self.names) * self.STEP
        self[word] = code
        return code


def neighbour_classes(texts: DataFrame, core: Model, bits: np.ndarray, most: int = 4_000_000) -> DataFrame:
    """(word, slot, n) for words outside the core whose bit is set, added up within a task.

    Slots count the classes of the words before, and from the number of classes on those of the words after.
    """
    classes = len(core.transitions)
    end = int(core.unit_class[-1])
    frequent = dict(zip(core.words[: core.frequent], core.unit_class.tolist()))
    shared = texts.sparkSession.sparkContext.broadcast((frequent, core.unit_class[core.frequent : -1], np.packbits(bits)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, family_class, packed = shared.value
        wanted = np.unpackbits(packed).view(bool)
        seen = _Seen(known, family_class, wanted)
        held: list[np.ndarray] = []

        def flushed(step: int = 100_000) -> Iterator[pa.RecordBatch]:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            names = pa.array(seen.names, pa.binary()).cast(pa.string())
            for a in range(0, len(found), step):
                some = found[a : a + step]
                word = names.take(pa.array(some // (2 * classes) - 1))
                slot = pa.array((some % (2 * classes)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([word, slot, pa.array(n[a : a + step])], ["word", "slot", "n"])

        for batch in slices(batches, "_text"):
            flat = [end]
            for text in batch.column("_text").to_pylist():
                flat.extend(map(seen.__getitem__, tokens(text)))
                flat.append(end)
            place, label = np.divmod(np.array(flat, np.int64), _Seen.STEP)
            at = np.flatnonzero(place)
            row = place[at] * (2 * classes)
            held += [row + label[at - 1], row + classes + label[at + 1]]
            if sum(map(len, held)) > most or len(seen) > most // 8:
                yield from flushed()
                held, seen = [], _Seen(known, family_class, wanted)
        if held:
            yield from flushed()

    return texts.select("_text").mapInArrow(count, "word string, slot int, n long")


def own_classes(neighbours: DataFrame, core: Model, enough: int) -> DataFrame:
    """(word, class): the class in which the core model finds the word's occurrences likeliest.

    This is the exchange of one word with the table of classes held fixed, so all words move at
    once, each in the task that holds its counts.  Words of fewer than ``enough`` occurrences,
    told by their successors, stay with their ending.
    """
    classes = len(core.transitions)
    weights = np.concatenate([core.transitions, core.transitions.T])
    emission = core.emission

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("slots")
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            pairs = lists.flatten()
            counts = np.zeros((batch.num_rows, 2 * classes))
            counts[row, pairs.field("slot").to_numpy()] = pairs.field("n").to_numpy()
            n = counts[:, classes:].sum(1)
            worth = counts @ weights - n[:, None] * emission
            worth[:, 0] = -np.inf
            # Sums may differ in their last bits by the batch a word is in.
            label = np.argmax(np.round(worth, 6), 1).astype(np.int32)
            keep = pa.array(n >= enough)
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(label)], ["word", "class"]).filter(keep)

    # One shuffle, by word: a word comes once a task and slot at most, whatever its frequency.
    each = neighbours.repartition("word").groupBy("word", "slot").agg(F.sum("n").alias("n"))
    slots = each.groupBy("word").agg(F.collect_list(F.struct("slot", "n")).alias("slots"))
    return slots.mapInArrow(best, "word string, class int")


def _labelled(docs: DataFrame, words: list[bytes], counts: np.ndarray, label: np.ndarray, core: Model) -> DataFrame:
    """Per document: the classes of its tokens, a byte each, and its unlisted words with the class of their ending."""
    end, ends = int(core.unit_class[-1]), core.ends
    shared = docs.sparkSession.sparkContext.broadcast((words, counts, label, core.unit_class[core.frequent : -1]))
    kind = docs.schema["_key"].dataType.simpleString()
    schema = f"_key {kind}, n_tokens long, n_listed long, listed double, labels binary, rare array<struct<word: string, ending: int>>"

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, label, family_class = shared.value
        known = {w: i for i, w in enumerate(words)}
        families = len(family_class)
        # Last the end, and before it what is not listed.
        classes = np.concatenate([label, [UNLISTED, end]]).astype(np.uint8)
        logs = np.concatenate([np.log10(counts + 1.0), [0.0, np.log10(ends + 1.0)]])
        has = np.concatenate([np.ones(len(words), np.int64), [0, ends > 0]])
        for batch in slices(batches, "_text"):
            flat: list[int] = []
            rare: list[bytes] = []
            sizes, rares = [0], [0]
            for text in batch.column("_text").to_pylist():
                own = tokens(text)
                ids = list(map(known.get, own, repeat(-2)))
                rare.extend(w for i, w in zip(ids, own) if i == -2)
                flat.extend(ids)
                flat.append(-1)
                sizes.append(len(flat))
                rares.append(len(rare))
            ids, first = np.array(flat, np.int64), np.array(sizes[:-1])
            line = classes[ids].tobytes()
            ending = family_class[np.array([family(w, families) for w in rare], np.int64)]
            pairs = pa.StructArray.from_arrays(
                [pa.array(rare, pa.binary()).cast(pa.string()), pa.array(ending.astype(np.int32))], ["word", "ending"]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(sizes).astype(np.int64)),
                    pa.array(np.add.reduceat(has[ids], first)),
                    pa.array(np.add.reduceat(logs[ids], first)),
                    pa.array([line[a:b] for a, b in zip(sizes[:-1], sizes[1:])], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(rares, pa.int32()), pairs),
                ],
                ["_key", "n_tokens", "n_listed", "listed", "labels", "rare"],
            )

    return docs.select("_key", "_text").mapInArrow(rate, schema)


def _whole_lines(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all tokens of a batch, those joined by word in their places, and each document's first token."""
    lines = batch.column("labels").to_pylist()
    label = np.frombuffer(b"".join(lines), np.uint8).copy()
    label[label == UNLISTED] = batch.column("joined").flatten().to_numpy()
    return label.astype(np.int64), np.cumsum([0, *map(len, lines)])[:-1]


def _class_bigrams(lines: DataFrame, classes: int) -> np.ndarray:
    """Counts of neighbouring classes; class 0, the end, also starts a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(classes * classes, np.int64)
        for batch in slices(batches, "labels"):
            label, _ = _whole_lines(batch)
            # Each text ends with class 0, so the one before a text's first token is 0 as well.
            before = np.concatenate([[0], label[:-1]])
            sums += np.bincount(before * classes + label, minlength=classes * classes)
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[found])], ["pair", "n"])

    table = np.zeros(classes * classes, np.int64)
    pairs = lines.select("labels", "joined").mapInArrow(count, "pair long, n long")
    # At most the square of the number of classes.
    for row in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect():
        table[row.pair] = row.n
    return table.reshape(classes, classes)


def _contexts(lines: DataFrame, transitions: np.ndarray, emission: np.ndarray) -> DataFrame:
    kind = lines.schema["_key"].dataType.simpleString()
    schema = f"_key {kind}, n_tokens long, n_known long, worth double, context double"

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "labels"):
            label, first = _whole_lines(batch)
            before = np.concatenate([[0], label[:-1]])
            context = np.add.reduceat(transitions[before, label] - emission[label], first)
            columns = [batch.column(c) for c in ("_key", "n_tokens", "n_known", "worth")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(context)], ["_key", "n_tokens", "n_known", "worth", "context"])

    return lines.mapInArrow(rate, schema)


def scored(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    frequent: int = 1000,
    families: int = 256,
    classes: int = 48,
    listed: int = 200_000,
    enough: int = 3,
    alpha: float = 0.5,
) -> DataFrame:
    """Key, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity.

    Learns from documents whose crc32 of the key, mod 7, is not 2, and scores all.  NULL and
    blank texts have the end as their only token.  Repeated rows and keys are documents like
    any other.  Without training documents every count is 0.  Texts of any length are read
    whole; a document's classes, a byte a token, are held by one task.  Other columns are not
    read, whatever their names.
    """
    if not 2 <= classes < UNLISTED:
        raise ValueError(f"classes must be from 2 to {UNLISTED - 1}")
    spark = docs.sparkSession
    small_batches(spark)
    stage = Stage(spark)
    base = docs.select(F.col(key).alias("_key"), text_of(text).alias("_text"))
    training = base.where(doc_crc("_key") % 7 != 2).select("_text")
    counts = stage.put("counts", word_counts(training, families))
    core = fit(counts, training, frequent, families, classes, listed, alpha)

    own = own_classes(neighbour_classes(training, core, _hopeful(counts, enough)), core, enough)
    exchanged = [(w.decode(), int(c)) for w, c in zip(core.words[: core.frequent], core.unit_class)]
    ending = F.lit(core.unit_class[core.frequent : -1].tolist())[F.col("family")]
    labels = own.unionByName(spark.createDataFrame(exchanged, "word string, class int"))
    known = counts.join(labels, "word", "left").select("word", "n", F.coalesce("class", ending).cast("int").alias("class"))
    vocabulary = stage.put("vocabulary", known)
    top = vocabulary.where(F.col("n") >= _least_listed(counts, listed)).toArrow()
    words = [w.encode() for w in top["word"].to_pylist()]

    parts = _labelled(base, words, top["n"].to_numpy(), top["class"].to_numpy(), core)
    parts = stage.put("parts", parts.withColumn("row", F.monotonically_increasing_id()))
    rare = (
        parts.select("row", F.posexplode("rare").alias("at", "one"))
        .select("row", "at", "one.ending", F.col("one.word").alias("word"))
        .join(vocabulary, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("rare_worth"),
            F.count("n").alias("rare_known"),
            F.array_sort(F.collect_list(F.struct("at", F.coalesce("class", "ending").cast("tinyint").alias("label")))).alias("found"),
        )
    )
    nothing = F.array().cast("array<tinyint>")
    joined = parts.drop("rare").join(rare, "row", "left").select(
        "_key",
        "n_tokens",
        (F.col("n_listed") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        (F.col("listed") + F.coalesce("rare_worth", F.lit(0.0))).alias("worth"),
        "labels",
        F.coalesce(F.col("found.label"), nothing).alias("joined"),
    )
    lines = stage.put("lines", joined)

    table = _class_bigrams(lines.where(doc_crc("_key") % 7 != 2), classes)
    transitions = np.log10((table + alpha) / (table.sum(1, keepdims=True) + alpha * classes))
    kinds = np.zeros(classes)
    kinds[0] = core.ends > 0
    for row in vocabulary.groupBy("class").agg(F.count("*").alias("k")).collect():
        kinds[row["class"]] = row.k
    emission = np.log10(table.sum(0) + kinds + 1)
    every = float(np.log10(core.total + core.distinct + 1))
    return (
        _contexts(lines, transitions, emission)
        .select(
            F.col("_key").alias(key),
            (doc_crc("_key") % 7 == 2).alias("held_out"),
            "n_tokens",
            "n_known",
            F.lit(core.total).cast("long").alias("train_tokens"),
            (F.col("worth") - F.col("n_tokens") * every).alias("base_score"),
            (F.col("worth") + F.col("context")).alias("score"),
        )
        .withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
    )
