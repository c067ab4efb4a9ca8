"""Packing pieces of documents into as few sequences as it can, by bin completion.

How many pieces there are of each length is all a packing depends on, and that table never has more
rows than a sequence has tokens.  A best-fit decreasing packing of it is the incumbent.  Where the
incumbent misses the lower bound, a branch-and-bound takes the largest length left, enumerates the
fillings around it that no other filling dominates, fullest first, and leaves a branch as soon as
its waste shows that it cannot beat the incumbent.  Spark tasks search, several branches at once.  The best
plan says which ranks of each length go into which sequences; each piece finds its place from its
rank among the pieces of its length.
"""

from __future__ import annotations

import json
import os
import re
import string
import zlib
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderflow.llm.common import WORD, slices, small_batches, text_of
from orderflow.llm.tokenfiles import byte_letters
from orderflow.session import Stage

# A filling is ((length, how many), ...), longest first; a packing counts equal fillings.
Filling = tuple[tuple[int, int], ...]
Packing = list[tuple[Filling, int]]

# --- bounds and the incumbent --------------------------------------------------------------


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing has fewer sequences (the bound L2 of Martello and Toth).

    For each a up to half the capacity: lengths above capacity - a stand alone, those above half
    each have a sequence of their own, and what is as long as a at least has to fit beside them.
    """
    many = np.concatenate([[0], np.cumsum(counts)])
    much = np.concatenate([[0], np.cumsum(counts * np.arange(capacity + 1))])
    half = capacity // 2
    a = np.arange(half + 1)
    alone = many[-1] - many[capacity - a + 1]
    halves = many[capacity - a + 1] - many[half + 1]
    beside = halves * capacity - (much[capacity - a + 1] - much[half + 1])
    left = much[half + 1] - much[a] - beside
    return int((alone + halves + np.maximum(0, -(-left // capacity))).max())


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> Packing:
    """Longest first, each into the fullest sequence that takes it; equal ones by count."""
    open_: dict[int, Counter] = {}  # room left -> fillings
    rooms = np.zeros(capacity + 1, bool)
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            fits = np.flatnonzero(rooms[length:])
            room = length + int(fits[0]) if len(fits) else capacity
            if not len(fits):
                open_[room] = Counter({(): -(-left // (room // length))})
            filling, there = next(iter(open_[room].items()))
            # A sequence that took one piece fits the next even better, so it is filled up.
            each = min(room // length, left)
            taken = min(left // each, there)
            if taken == there:
                del open_[room][filling]
            else:
                open_[room][filling] -= taken
            rooms[room] = bool(open_[room])
            if not open_[room]:
                del open_[room]
            rest = room - each * length
            open_.setdefault(rest, Counter())[(*filling, (length, each))] += taken
            rooms[rest] = True
            left -= each * taken
        if capacity in open_:  # planned for pieces that found better room
            rooms[capacity] = False
            del open_[capacity]
    return [(f, n) for fillings in open_.values() for f, n in fillings.items()]


# --- completions ---------------------------------------------------------------------------


def completions(counts: np.ndarray, room: int, waste: int, most: int, enough: int) -> tuple[list[Filling], bool]:
    """Undominated fillings of ``room`` that leave at most ``waste`` empty, fullest first.

    Filling a is dominated by b if a's pieces can be packed into places of the size of b's: then
    b is never worse.  So a filling goes if a piece that is left would still fit, if some of its
    pieces could be exchanged for a single longer one, or two and more for one of their sum.
    The work ends after ``most`` steps or with ``enough`` fillings that leave nothing empty; the
    second result tells whether all fillings were seen.
    """
    there = np.flatnonzero(counts[: room + 1]).tolist()
    there = there[1:] if there and not there[0] else there
    held = {x: int(counts[x]) for x in there}
    lengths, falling = there[::-1], [-x for x in there[::-1]]
    tokens = [*np.cumsum([held[x] * x for x in there])[::-1].tolist(), 0]
    found: list[Filling] = []
    steps = exact = 0

    def keep(filling: Filling, left: int) -> None:
        nonlocal exact
        if left <= waste and not dominated(filling, held, there, left):
            found.append(filling)
            exact += not left

    def grow(at: int, left: int, filling: Filling) -> None:
        nonlocal steps
        steps += 1
        keep(filling, left)
        first = bisect_left(falling, -left, at)
        if first < len(lengths) and lengths[first] == left:
            keep((*filling, (left, 1)), 0)  # one piece that fills what is left
            first += 1
        for i in range(first, len(lengths)):
            if steps > most or exact >= enough or left - tokens[i] > waste:
                return  # in the last case even all shorter pieces would waste too much
            length = lengths[i]
            for times in range(min(left // length, held[length]), 0, -1):
                grow(i + 1, left - times * length, (*filling, (length, times)))

    grow(0, room, ())
    order = sorted(found, key=lambda f: (-sum(a * n for a, n in f), sum(n for _, n in f), f))
    return order, steps <= most and exact < enough


def dominated(filling: Filling, held: dict[int, int], there: list[int], slack: int) -> bool:
    """Whether a piece that is left could be added, or stand for pieces that are no longer in all."""
    used, sums = dict(filling), {0: 0}
    for length, times in filling:  # reachable sums, each with the most pieces that make it
        for total, pieces in list(sums.items()):
            for k in range(1, times + 1):
                at = total + k * length
                sums[at] = max(sums.get(at, 0), pieces + k)
    for total, pieces in sums.items():
        # A single piece is no reason to exchange one of its own length.
        at = bisect_left(there, total if pieces > 1 else total + 1)
        while at < len(there) and there[at] <= total + slack:
            if held[there[at]] > used.get(there[at], 0):
                return True
            at += 1
    return False


class Effort(NamedTuple):
    """How far a search goes; a packing is whole whatever these are."""

    nodes: int = 8000  # visits
    steps: int = 100  # fillings looked at in a visit
    enough: int = 2  # full ones that end a visit's look


class Found(NamedTuple):
    bins: int
    packing: Packing
    whole: bool  # nothing was left out, so no packing is better


def search(counts: np.ndarray, capacity: int, begun: Packing, best: int, effort: Effort) -> Found:
    """Bin completion below ``begun``: the best packing of fewer than ``best`` sequences.

    Equal sequences are branched on together: a filling is taken as often as it can be, then less
    often.  What is left to pack decides the rest of a branch, so the same remainder is not
    visited again with as many sequences.  Now and then the remainder is packed by best fit, which
    may be the next incumbent.
    """
    counts = counts.astype(np.int64)
    total, least = int((counts * np.arange(capacity + 1)).sum()), lower_bound(counts, capacity)
    known: dict[bytes, int] = {}
    packing, whole, visits = [], True, 0

    def take(filling: Filling, times: int) -> None:
        for length, n in filling:
            counts[length] -= n * times

    def spare(filling: Filling) -> int:
        return capacity - sum(a * n for a, n in filling)

    def choices(bins: int, waste: int) -> Iterator[tuple[Filling, int]]:
        """What a node branches into; nothing where no better packing can be below it."""
        nonlocal best, packing, whole, visits
        visits += 1
        there = np.flatnonzero(counts)
        if bins + lower_bound(counts, capacity) >= best:
            return
        if not len(there):
            best, packing = bins, list(path)
            return
        state = blake2b(counts.tobytes(), digest_size=16).digest()
        if known.get(state, bins + 1) <= bins:
            return
        known[state] = bins
        if visits % 256 == 1:
            rest = best_fit_decreasing(counts, capacity)
            if bins + sum(n for _, n in rest) < best:
                best, packing = bins + sum(n for _, n in rest), [*path, *rest]
        largest = int(there[-1])
        counts[largest] -= 1
        room, allowed = capacity - largest, (best - 1) * capacity - total - waste
        options, all_seen = completions(counts, room, allowed, effort.steps, effort.enough)
        counts[largest] += 1
        whole &= all_seen
        for filling in (_with(f, largest) for f in options):
            times = min(int(counts[a]) // n for a, n in filling)
            # A single filling that nothing dominates is never worse than another one.
            fewest = times - 1 if all_seen and len(options) == 1 else 0
            while times > fewest:
                if empty := spare(filling):  # no more of them than a better packing may waste
                    times = min(times, ((best - 1) * capacity - total - waste) // empty)
                if times > fewest:
                    yield filling, times
                times -= 1

    path: Packing = []
    for filling, times in begun:
        take(filling, times)
        path.append((filling, times))
    bins, waste = sum(n for _, n in path), sum(spare(f) * n for f, n in path)
    stack = [choices(bins, waste)]
    while stack and best > least:
        if visits >= effort.nodes:
            whole = False
            break
        chosen = next(stack[-1], None)
        if chosen is None:
            stack.pop()
            if stack:
                filling, m = path.pop()
                take(filling, -m)
                bins, waste = bins - m, waste - spare(filling) * m
            continue
        filling, m = chosen
        take(filling, m)
        path.append(chosen)
        bins, waste = bins + m, waste + spare(filling) * m
        stack.append(choices(bins, waste))
    return Found(best, packing, whole or best <= least)


def _with(filling: Filling, length: int) -> Filling:
    """The filling and one piece more of a length no shorter than its own."""
    if filling and filling[0][0] == length:
        return ((length, filling[0][1] + 1), *filling[1:])
    return ((length, 1), *filling)


def best_packing(spark: SparkSession, counts: np.ndarray, capacity: int, effort: Effort, branches: int) -> Packing:
    """The best fit decreasing packing, or a better one where the bound leaves room for it.

    One task dives first, since the first way down often reaches the bound.  If it does not, the
    choices for the first length that has some, a filling and how often it is taken, are
    branches that Spark tasks search at the same time.
    """
    packing = best_fit_decreasing(counts, capacity)
    least = lower_bound(counts, capacity)

    def tried(starts: list[Packing], packing: Packing) -> Packing:
        bins = sum(n for _, n in packing)

        def explore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number in batch.column(0).to_pylist():
                    found = search(counts, capacity, starts[number], bins, effort)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number]), pa.array([found.bins]), pa.array([json.dumps(found.packing)])],
                        ["branch", "bins", "packing"],
                    )

        rows = spark.range(len(starts), numPartitions=len(starts))
        won = rows.mapInArrow(explore, "branch long, bins long, packing string").orderBy("bins", "branch").first()
        if won["bins"] >= bins:
            return packing
        return [(tuple(map(tuple, filling)), n) for filling, n in json.loads(won["packing"])]

    for starts in (lambda: [[]], lambda: first_choices(counts, capacity, packing, effort, branches)):
        if sum(n for _, n in packing) > least and (found := starts()):
            packing = tried(found, packing)
    return packing


def first_choices(counts: np.ndarray, capacity: int, packing: Packing, effort: Effort, branches: int) -> list[Packing]:
    """Ways to begin: what has a single filling is packed, then each filling of the next length."""
    rest, begun = counts.copy(), []
    waste = (sum(n for _, n in packing) - 1) * capacity - int((counts * np.arange(capacity + 1)).sum())
    while rest.any():
        largest = int(np.flatnonzero(rest)[-1])
        rest[largest] -= 1
        inner, all_seen = completions(rest, capacity - largest, waste, effort.steps, effort.enough)
        rest[largest] += 1
        most = [(f, min(int(rest[a]) // n for a, n in f)) for f in (_with(f, largest) for f in inner)]
        if len(most) != 1 or not all_seen:
            less = range(max((times for _, times in most), default=0))
            return list(islice(([*begun, (f, times - j)] for j in less for f, times in most if times > j), branches))
        begun += most
        filling, times = most[0]
        waste -= times * (capacity - sum(a * n for a, n in filling))
        for a, n in filling:
            rest[a] -= n * times
    return [begun]


# --- pieces --------------------------------------------------------------------------------

FIND = re.compile(WORD).findall
# Letters whose lower case does not depend on what is around them and that are in NFC.
PLAIN = re.compile(r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u02AF]+").fullmatch
CACHE_BYTES = 64 << 20
# What a tokenizer file has to say for its ids to be those of its words between ASCII white
# space: nothing in it looks across white space or keeps it.
NORMALISERS = {"NFC", "Lowercase", "Replace"}


class Words(dict):
    """Little-endian ids of words between white space, kept up to a bound of bytes.

    A run of plain letters is one piece and goes to the merge model alone; marks behind it are a
    piece of their own.  Every other word passes the whole tokenizer.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.merges, self.letters, self.held = tokenizer, tokenizer.model.tokenize, byte_letters(), 0

    def forget(self) -> None:
        self.clear()
        self.held = 0

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        lower = word.lower()
        if PLAIN(lower):
            if lower != word:
                ids = self[lower]
            else:
                found = self.merges(word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))
                ids = array("I", [t.id for t in found]).tobytes()
        else:
            stem = word.rstrip(string.punctuation)
            ids = self[stem] + self[word[len(stem) :]] if stem != word and PLAIN(stem) else self.whole(word)
        if self.held > CACHE_BYTES:
            self.forget()
        self.held += len(word) + len(ids) + 180  # what Python adds to both
        self[word] = ids
        return ids


class Encoder:
    """Little-endian ids of whole texts, each with the end id.

    Where the tokenizer drops white space and looks at each word alone, so does this; any other
    tokenizer gets whole texts.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.end, self.by_word = array("I", [end_id]).tobytes(), drops_white_space(path)
        self.words = Words(Tokenizer.from_file(path))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [self.words.whole(t) + self.end for t in texts]
        get = self.words.__getitem__
        return [b"".join(map(get, FIND(t))) + self.end for t in texts]


def drops_white_space(path: str) -> bool:
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    normaliser, cutter = told.get("normalizer") or {}, told.get("pre_tokenizer") or {}
    steps = normaliser.get("normalizers", [normaliser] if normaliser else [])
    cuts = cutter.get("pretokenizers", [cutter])
    spaces = [s for s in steps if s["type"] == "Replace"]
    first = cuts[0] if cuts else {}
    pattern = first.get("pattern", {}).get("Regex", "")
    tokens = [t["content"] for t in told.get("added_tokens", [])]
    return (
        {s["type"] for s in steps} <= NORMALISERS
        and all(s["pattern"] == {"Regex": r"\s+"} and s["content"] == " " for s in spaces)
        and first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and bool(first.get("invert"))
        and pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        and not re.search(r"[\s.]", pattern.split(r"|[\p{L}]+")[0])
        and all(c.get("type") == "ByteLevel" and not c.get("add_prefix_space") and not c.get("use_regex") for c in cuts[1:])
        and told.get("post_processor") is None
        and not any(re.fullmatch(WORD, t) is None for t in tokens)
        and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in told.get("added_tokens", []))
    )


@cache
def encoder(path: str, end_id: int) -> Encoder:
    return Encoder(path, end_id)


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int, key: str, text: str) -> DataFrame:
    """Token ids of whole texts in pieces of ``capacity``, with their place in the task.

    ``part`` and ``nth`` (a piece's number among those of its length in the task) name a piece once
    the rows are written.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long, tokens array<int>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, ids_of = TaskContext.get().partitionId(), encoder(path, end_id)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, 1):
            ids = ids_of(batch.column(1).to_pylist())
            sizes = np.array([len(x) // 4 for x in ids])
            each = -(-sizes // capacity)
            row = np.repeat(np.arange(len(ids)), each)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            start = piece * capacity
            length = np.minimum(sizes[row] - start, capacity)
            nth = seen[length] + place_among_equals(length)
            seen += np.bincount(length, minlength=capacity + 1)
            crc = [zlib.crc32(ids[r][4 * a : 4 * (a + n)]) for r, a, n in zip(row.tolist(), start.tolist(), length.tolist())]
            ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(ids), "<i4"))
            numbers = [start, length, np.array(crc, np.int64), np.full(len(row), part, np.int32), nth]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), *map(pa.array, numbers), tokens],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "tokens"],
            )
        ids_of.words.forget()  # the worker goes on to other stages

    small_batches(docs.sparkSession, 2000)
    return docs.select(F.col(f"`{key}`").alias("key"), text_of(F.col(f"`{text}`")).alias("body")).mapInArrow(cut, schema)


def place_among_equals(values: np.ndarray) -> np.ndarray:
    """For each value how many equal ones stand before it."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    opens = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(values) else np.zeros(0, int)
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - np.repeat(opens, np.diff([*opens, len(values)]))
    return out


# --- the packing ---------------------------------------------------------------------------

RANKS = 1 << 44  # more pieces of one length than any table has


class Plan:
    """Where the pieces of each length go, by their rank among them."""

    def __init__(self, packing: Packing):
        rows, used, sequence = [], Counter(), 0
        for filling, times in packing:
            offset = 0
            for length, each in filling:
                rows.append((length * RANKS + used[length], sequence, each, offset))
                used[length] += each * times
                offset += each * length
            sequence += times
        rows.sort()
        self.first, self.sequence, self.each, self.offset = np.array(rows, np.int64).reshape(-1, 4).T
        self.sequences = sequence

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequence and the offset in it of pieces with a length and a rank."""
        wanted = length * RANKS + rank
        at = np.searchsorted(self.first, wanted, side="right") - 1
        beyond = wanted - self.first[at]
        return self.sequence[at] + beyond // self.each[at], self.offset[at] + beyond % self.each[at] * length


def pack(
    docs: DataFrame,
    path: str,
    capacity: int = 2048,
    end_id: int = 0,
    key: str = "doc_id",
    text: str = "text",
    keep_tokens: bool = True,
    effort: Effort = Effort(),
    branches: int = 12,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, tokens]) per piece.

    Whole texts are encoded and closed by ``end_id``; NULL and empty texts are that id alone, and
    only texts of more than ``capacity`` ids are cut.  NULL keys, repeated keys and repeated rows are
    documents like all others.  An empty table gives an empty result.  Other columns are ignored,
    whatever their names.  Very long texts are held one at a time, as bytes of ids.

    The driver holds a count per length, ``capacity`` numbers at most.  ``effort`` and ``branches`` bound
    the search for a better packing than best-fit decreasing, not the result: every piece is packed.
    """
    spark, stage = docs.sparkSession, Stage(docs.sparkSession)
    cut = stage.put("pieces", pieces(docs, path, end_id, capacity, key, text))
    held = stage.put("held", cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in held.groupBy("length").agg(F.sum("n")).collect():
        counts[length] = n
    plan = Plan(best_packing(spark, counts, capacity, effort, branches))

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["tokens"] * keep_tokens]
    ranked = cut.join(offsets, ["part", "length"]).select(*columns, (F.col("before") + F.col("nth")).alias("rank"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.select(*columns).schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(len(columns)).to_numpy()
            found = plan.places(length, rank) if len(length) else (length, rank)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(columns)], *map(pa.array, found)], [*columns, "sequence_id", "offset"]
            )

    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, tokens, pieces) out of pieces with their tokens, in order of offset.

    A sequence holds ``capacity`` tokens at most, so its group is small whatever the table.
    """
    piece = F.struct("offset", "doc_id", "piece", "length", "tokens")
    grouped = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("found"))
    return grouped.select(
        "sequence_id",
        F.flatten(F.transform("found", lambda p: p["tokens"])).alias("tokens"),
        F.transform("found", lambda p: p.dropFields("tokens")).alias("pieces"),
    )
