"""Benchmark decontamination: BM25 over an inverted index of test items, by block-max WAND.

The roles are turned round: the test items are indexed, and every passage of every training
text is a query.  A posting's impact is the BM25 part of its term divided by the score the item
gives itself, so a score says which share of the item a passage covers, and one threshold fits
all items.  Items above it are verified in windows of their own size: one and the same window must
reach the score and hold enough of the question's and of the answer's word sequences.  Items are
indexed in bands of like length, each with passages of its own, so a long item does not widen the
passages that short ones are looked for in.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.llm.common import SLICE, free_name, slices, small_batches, without

WORDS = re.compile(r"\w+").findall
K1, B = 1.2, 0.75
SHORT = 8
MATCH = T.ArrayType(
    T.StructType(
        [
            T.StructField("item_id", T.LongType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("question_overlap", T.DoubleType()),
            T.StructField("answer_overlap", T.DoubleType()),
            T.StructField("first_word", T.IntegerType()),
            T.StructField("last_word", T.IntegerType()),
        ]
    )
)


def tokens(text: str) -> list[str]:
    return WORDS(text.lower())


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's last sentence is its answer; an item of one sentence has no answer."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+|\n+", text.strip()) if WORDS(p)]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


def sequences(words: list[str], width: int = 3) -> set[tuple[str, ...]]:
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if width else set()


def window_of(length: int) -> int:
    """The words among which an item of so many words must stand."""
    return length + length // 2 + 4


def band_of(length: int) -> int:
    """Items whose windows differ by less than four times share a band."""
    return max(0, (window_of(length) - 1).bit_length() - 4) // 2


@dataclass
class Index:
    """Postings by term, in item order, with the greatest impact of each block of postings."""

    ids: list[int]
    questions: list[list[str]]
    answers: list[list[str]]
    terms: dict[str, int]
    items: list[list[int]]
    impacts: list[list[float]]
    peaks: list[list[float]]
    most: np.ndarray
    parts: list[dict[str, float]]  # of each item: its terms' impacts
    longest: int
    threshold: float
    block: int
    # For the bound on whole passages: postings of the terms that are not common, and how much
    # of its own score each item owes to common terms.
    common: np.ndarray = field(default_factory=lambda: np.empty(0, bool))
    owed: np.ndarray = field(default_factory=lambda: np.empty(0))

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items whose score reaches the threshold, by block-max WAND.

        Cursors stand in order of their items.  The pivot is the first cursor at which the
        greatest impacts add up to the threshold; only its item can come next.  If the peaks of
        the blocks that would hold it do not, all cursors up to it jump past the nearest block's
        end; else the item is scored, or a cursor behind is moved up to it.
        """
        threshold, block = self.threshold - 1e-9, self.block
        cursors = [[self.items[t][0], 0, t] for t in terms]
        found = []
        while cursors:
            cursors.sort()
            reach, pivot = 0.0, -1
            for i, cursor in enumerate(cursors):
                reach += self.most[cursor[2]]
                if reach >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            reach, ahead = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else len(self.ids)
            for cursor in cursors[: pivot + 1]:
                items = self.items[cursor[2]]
                at = bisect_left(items, item, cursor[1])
                k = at // block
                if at < len(items):
                    reach += self.peaks[cursor[2]][k]
                    last = items[min((k + 1) * block, len(items)) - 1] + 1
                    ahead = min(ahead, last)
            if reach < threshold:
                target = max(ahead, item + 1)
                moved = cursors[: pivot + 1]
            elif cursors[0][0] == item:
                moved = cursors[: pivot + 1]
                score = sum(self.impacts[c[2]][c[1]] for c in moved)
                if score >= threshold:
                    found.append((item, score))
                target = item + 1
            else:
                target, moved = item, [c for c in cursors[:pivot] if c[0] < item]
            for cursor in moved:
                items = self.items[cursor[2]]
                cursor[1] = bisect_left(items, target, cursor[1])
                cursor[0] = items[cursor[1]] if cursor[1] < len(items) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def possible(self, window: np.ndarray, term: np.ndarray, windows: int) -> np.ndarray:
        """Which windows' terms can reach the threshold for some item at all.

        An item gets at most what it owes to common terms, and the impacts of the other terms
        the window has.  (window, term) pairs are distinct.
        """
        rare = ~self.common[term]
        window, term = window[rare], term[rare]
        count = self.flat_first[term + 1] - self.flat_first[term]
        w = np.repeat(window, count)
        at = np.repeat(self.flat_first[term] - np.cumsum(count) + count, count) + np.arange(count.sum())
        pair = w * len(self.ids) + self.flat_items[at]
        order = np.argsort(pair, kind="stable")
        pair, impact = pair[order], self.flat_impacts[at[order]]
        if not len(pair):
            return np.zeros(windows, bool)
        begins = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        sums = np.add.reduceat(impact, begins)
        item = pair[begins] % len(self.ids)
        out = np.zeros(windows, bool)
        out[pair[begins][sums >= self.threshold - self.owed[item] - 1e-9] // len(self.ids)] = True
        return out

    def prepared(self) -> Index:
        lengths = [len(x) for x in self.items]
        self.flat_first = np.concatenate([[0], np.cumsum(lengths)])
        self.flat_items = np.array([i for x in self.items for i in x], np.int64)
        self.flat_impacts = np.array([i for x in self.impacts for i in x])
        # Common terms: the longest lists, while no item owes them half the threshold.
        self.common, self.owed = np.zeros(len(lengths), bool), np.zeros(len(self.ids))
        for t in np.argsort([-n for n in lengths], kind="stable"):
            more = self.owed[self.items[t]] + self.impacts[t]
            if lengths[t] < 2 or more.max() > self.threshold / 2:
                break
            self.common[t] = True
            self.owed[self.items[t]] = more
        return self


def weighed_terms(items: DataFrame, text: str = "text", key: str = "item_id") -> DataFrame:
    """(item, text, terms): the terms of every distinct item with their idf over all items."""
    rows = (
        items.where(F.col(key).isNotNull() & F.col(text).isNotNull())
        .select(F.col(key).cast("long").alias("item"), F.col(text).alias("body"))
        .distinct()
    )
    found = F.regexp_extract_all(F.lower("body"), F.lit(r"(?U)\w+"), F.lit(0))
    rows = rows.withColumn("words", found).where(F.size("words") > 0)
    return rows


def build_indexes(
    items: DataFrame,
    threshold: float,
    text: str = "text",
    key: str = "item_id",
    per_index: int = 20_000,
    block: int = 8,
    most_words: int = 2_000_000,
) -> Iterator[list[Index]]:
    """Indexes of about ``per_index`` items and ``most_words`` words, by bands, with statistics over all items.

    Every list of them is small enough to be broadcast; many items make many lists, one at a time.
    """
    rows = weighed_terms(items, text, key)
    total, average, held = rows.agg(F.count("*"), F.avg(F.size("words")), F.sum(F.size("words"))).first()
    if not total:
        return
    parts = max(-(-total // per_index), -(-held // most_words))
    seen = rows.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    numbered = rows.withColumn("part", F.pmod(F.xxhash64("item", "body"), F.lit(parts)))
    for part in range(parts):
        mine = numbered.where(F.col("part") == part)
        chosen = sorted((r.item, r.body) for r in mine.select("item", "body").collect())
        used = mine.select(F.explode("words").alias("term")).distinct()
        df = {r.term: r.df for r in seen.join(used, "term", "left_semi").collect()}
        bands: dict[int, list[tuple[int, str]]] = {}
        for item, body in chosen:
            bands.setdefault(band_of(len(tokens(body))), []).append((item, body))
        yield [
            make_index(alike, df, total, average, max(len(tokens(body)) for _, body in alike), threshold, block)
            for _, alike in sorted(bands.items())
        ]


def make_index(
    chosen: list[tuple[int, str]], df: dict[str, int], total: int, average: float, longest: int, threshold: float, block: int = 8
) -> Index:
    bodies = [tokens(body) for _, body in chosen]
    terms: dict[str, int] = {}
    items: list[list[int]] = []
    impacts: list[list[float]] = []
    shares: list[dict[str, float]] = []
    for i, words in enumerate(bodies):
        norm = K1 * (1 - B + B * len(words) / average)
        parts = {}
        for w in sorted(set(words)):
            tf = words.count(w)
            idf = np.log(1 + (total - df.get(w, 1) + 0.5) / (df.get(w, 1) + 0.5))
            parts[w] = idf * tf * (K1 + 1) / (tf + norm)
        own = sum(parts.values())
        shares.append({w: float(value / own) for w, value in parts.items()})
        for w, value in parts.items():
            t = terms.setdefault(w, len(terms))
            if t == len(items):
                items.append([])
                impacts.append([])
            items[t].append(i)
            impacts[t].append(float(value / own))
    split = [question_and_answer(body) for _, body in chosen]
    return Index(
        ids=[item for item, _ in chosen],
        questions=[tokens(q) for q, _ in split],
        answers=[tokens(a) for _, a in split],
        terms=terms,
        items=items,
        impacts=impacts,
        peaks=[[max(x[k : k + block]) for k in range(0, len(x), block)] for x in impacts],
        most=np.array([max(x) for x in impacts]),
        parts=shares,
        longest=longest,
        threshold=threshold,
        block=block,
    ).prepared()


def _share(wanted: set, there: set) -> float:
    return len(wanted & there) / len(wanted) if wanted else 1.0


def _checked(words: list[str]) -> set[tuple[str, ...]]:
    """What of a question or answer is looked for: one changed word would break all sequences of a short one."""
    return sequences(words, 3 if len(words) >= SHORT else 1)


class Scanner:
    """Finds the items that texts contain; one per task."""

    def __init__(self, indexes: Index | list[Index], overlap: float):
        self.indexes = [indexes] if isinstance(indexes, Index) else indexes
        self.overlap = overlap
        self.seen: dict[tuple, list] = {}

    def __call__(self, texts: list[str | None]) -> list[list[dict]]:
        """For each text its verified items, the best window of each."""
        words = [tokens(t or "") for t in texts]
        out: list[list[dict]] = [[] for _ in texts]
        for band in range(len(self.indexes)):
            self._scan(band, words, out)
        return [self._best(found) for found in out]

    def _scan(self, band: int, words: list[list[str]], out: list[list[dict]]) -> None:
        """A passage has twice the words of the band's widest window and starts every so many.

        So every window of every item stands whole in the passage in whose first half it begins.
        """
        index = self.indexes[band]
        stride = window_of(index.longest)
        counts = np.array([len(w) for w in words])
        flat = np.fromiter((i for w in words for i in map(index.terms.get, w, repeat(-1))), np.int64, counts.sum())
        bins = np.maximum(-(-counts // stride), 1)
        base = np.concatenate([[0], np.cumsum(bins)])
        doc = np.repeat(np.arange(len(words)), counts)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
        cell = base[doc] + place // stride
        hit = flat >= 0
        size = len(index.terms)
        # A passage is a cell and the one after it, in the same text.
        mine = cell[hit] * size + flat[hit]
        before = (cell[hit] - 1) * size + flat[hit]
        first = np.zeros(base[-1], bool)
        first[base[:-1]] = True
        pairs = np.unique(np.concatenate([mine, before[~first[cell[hit]]]]))
        window, term = pairs // size, pairs % size
        possible = index.possible(window, term, base[-1])
        edges = np.searchsorted(window, np.arange(base[-1] + 1))
        for w in np.flatnonzero(possible):
            d = int(np.searchsorted(base, w, side="right")) - 1
            begin = int(w - base[d]) * stride
            passage = words[d][begin : begin + 2 * stride]
            self._verify(band, term[edges[w] : edges[w + 1]].tolist(), passage, begin, out[d])

    def _verify(self, band: int, terms: list[int], passage: list[str], begin: int, out: list[dict]) -> None:
        key = (band, *passage)
        if key not in self.seen:
            if len(self.seen) > 2000:
                self.seen.clear()
            index, there, rows = self.indexes[band], None, []
            for item, _ in index.search(terms):
                there = there or sequences(passage) | sequences(passage, 2) | sequences(passage, 1)
                question, answer = _checked(index.questions[item]), _checked(index.answers[item])
                # What the passage has not, no window of it has.
                if _share(question, there) >= self.overlap and _share(answer, there) >= self.overlap:
                    rows += self._in_window(index, item, passage, question, answer)
            self.seen[key] = rows
        out.extend({**row, "first_word": row["first_word"] + begin, "last_word": row["last_word"] + begin} for row in self.seen[key])

    def _in_window(self, index: Index, item: int, passage: list[str], question: set, answer: set) -> list[dict]:
        """The item's best window: among those that reach score and overlaps, the highest, then the first.

        Windows that begin at a word of the item are enough: any other has no more of it than the next of these.
        """
        impacts, width = index.parts[item], window_of(len(index.questions[item]) + len(index.answers[item]))
        half = window_of(index.longest)
        places = [i for i, w in enumerate(passage) if w in impacts]
        held: Counter[str] = Counter()
        best, score, upto = None, 0.0, 0
        for k, place in enumerate(places):
            if place >= half:
                break
            while upto < len(places) and places[upto] < place + width:
                w = passage[places[upto]]
                score += impacts[w] * (not held[w])
                held[w] += 1
                upto += 1
            if score >= index.threshold - 1e-9 and (best is None or score > best["score"] + 1e-9):
                end = places[upto - 1]
                part = passage[place : end + 1]
                there = sequences(part) | sequences(part, 2) | sequences(part, 1)
                asked, told = _share(question, there), _share(answer, there)
                if asked >= self.overlap and told >= self.overlap:
                    best = {"item_id": index.ids[item], "score": score, "question_overlap": asked, "answer_overlap": told,
                            "first_word": place, "last_word": end}
            w = passage[place]
            held[w] -= 1
            score -= impacts[w] * (not held[w])
        return [best] if best else []

    @staticmethod
    def _best(found: list[dict]) -> list[dict]:
        best: dict[int, dict] = {}
        for row in found:
            if row["item_id"] not in best or row["score"] > best[row["item_id"]]["score"] + 1e-12:
                best[row["item_id"]] = row
        return [best[i] for i in sorted(best)]


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    threshold: float = 0.6,
    overlap: float = 0.5,
    keep: list[str] | None = None,
    column: str = "leaks",
    per_index: int = 20_000,
) -> DataFrame:
    """``docs`` with an array of the test items each text holds; empty where it is clean.

    Texts of any length are searched whole.  NULL, blank and repeated texts are searched like any other; items with a NULL id or text
    or without words are no items; equal items count once, and items that share an id are
    searched one by one.  A column named like the new one is replaced, the rest, or those in
    ``keep``, are handed through.
    """
    small_batches(docs.sparkSession)
    frame = without(docs, column)
    keep = list(frame.columns if keep is None else keep)
    empty = F.array().cast(MATCH)
    frame = frame.select(*dict.fromkeys([*keep, text])).withColumn(column, empty)
    for indexes in build_indexes(items, threshold, per_index=per_index):
        frame = _scanned(frame, indexes, text, overlap, column)
    return frame.select(*keep, column)


def _scanned(frame: DataFrame, indexes: list[Index], text: str, overlap: float, column: str) -> DataFrame:
    shared = frame.sparkSession.sparkContext.broadcast(indexes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value, overlap)
        for batch in slices(batches, text, SLICE):
            found = scanner(batch.column(text).to_pylist())
            so_far = batch.column(column)
            joined = [a + b for a, b in zip(so_far.to_pylist(), found)]
            names = batch.schema.names
            columns = [pa.array(joined, so_far.type) if n == column else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return frame.mapInArrow(scan, frame.schema)


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without the texts that hold a test item."""
    leaks = free_name(docs, "_leaks")
    found = find_leaks(docs, items, text, column=leaks, **options)
    return found.where(F.size(leaks) == 0).drop(leaks)
