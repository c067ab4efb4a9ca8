"""Similarity join on word shingles by adaptive multi-match prefixes, and its components.

Texts that are equal as word sequences are one class.  Two classes link when the Jaccard
similarity of their shingle sets reaches the threshold.

1. A shingle that only one class has cannot be in an intersection.  Shingles are dealt out by
   hash, those of two or more classes are sent back, and a class of which too few are shared
   is done.  Shingles met twice in one pack of documents are known to be shared there and then
   and travel once per pack, so no shingle's list grows with its frequency alone.
2. The rest order their shared shingles by document frequency, rare first.  With need = the
   least intersection that reaches the threshold, two linked sets have at least l shingles in
   common among the first (size - need + l) of each.  A class takes the l with the least
   estimated cost: a longer prefix reads more lists but asks for more matches.  Every prefix
   shingle carries the l at which it enters, so two classes compare at the smaller l.
3. Linked classes form components.  Star rounds compare every class of a shingle's list with
   one hub of it, the class with the fewest lone shingles, which joins a family of copies with
   as many pairs as it has members.  Then no pair of different components is left out: those
   that meet in short lists and match often enough are verified pair by pair; classes that
   meet in long lists form families, and a family is verified block against block, where only
   links come out and components that have met are not compared again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.llm.common import SLICE, free_name, given_back, hashed_words, mixed_bits, new_name, set_aside, slices, small_batches, text_of
from orderflow.session import Stage

WIDTH = 5
PERCENT = 80
PACKED = "q int, cls binary, counts binary, sizes binary, shingles binary"
LOW = np.uint64((1 << 48) - 1)


def class_of(hashes: np.ndarray) -> int:
    """A 64-bit name of a word sequence, never 0."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True) or 1


def shingles(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingles; fewer words than the width are one shingle together."""
    if not len(hashes):
        return hashes
    if len(hashes) < width:
        seed = np.uint64(class_of(hashes) & (2**64 - 1))
        return mixed_bits(np.array([seed ^ np.uint64(len(hashes))]))
    rolled = hashes[: len(hashes) - width + 1].copy()
    for j in range(1, width):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[j : len(hashes) - width + 1 + j]
    return np.unique(mixed_bits(rolled))


def classes(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns to keep, class (NULL without words) and number of words per document.

    The two added come last; where a kept column has their name, underscores are put before.
    """
    frame = docs.select(*keep)
    added = [free_name(frame, "cls"), free_name(frame, "n_words")]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(keep), SLICE):
            found, first = hashed_words(batch.column(len(keep)).to_pylist())
            names = [class_of(found[a:b]) if b > a else None for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(names, pa.int64()), pa.array(np.diff(first).astype(np.int64))],
                [*keep, *added],
            )

    kinds = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in added)])
    return docs.select(*keep, text_of(text).alias(free_name(docs, "_text"))).mapInArrow(name, kinds)


def _grouped(cls: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct classes, how many shingles each has, and the shingles in that order."""
    order = np.argsort(cls, kind="stable")
    names, counts = np.unique(cls[order], return_counts=True)
    return names, counts.astype(np.uint32), shingle[order]


def _six(values: np.ndarray) -> bytes:
    """The low 48 bits of each; the part number holds the bits on top."""
    return np.ascontiguousarray((values & LOW).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(raw: bytes, part: int, bits: int) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel() | np.uint64(part << (64 - bits))


class Pack:
    """Shingle sets of some documents, gathered until there are enough to deal out."""

    def __init__(self, bits: int, most: int):
        self.bits, self.most = bits, most
        self.sets: dict[int, np.ndarray] = {}
        self.held = 0

    def add(self, hashes: np.ndarray) -> None:
        name = class_of(hashes)
        if name not in self.sets:
            self.sets[name] = shingles(hashes)
            self.held += len(self.sets[name])

    def rows(self) -> Iterator[tuple]:
        """(part, q, classes, counts, sizes, shingles): q is set on what goes straight back."""
        names = np.fromiter(self.sets, np.int64, len(self.sets))
        sizes = np.array([len(s) for s in self.sets.values()], np.uint32)
        owner = np.repeat(names, sizes)
        every = np.concatenate(list(self.sets.values()))
        self.sets, self.held = {}, 0
        order = np.argsort(every)
        every, owner = every[order], owner[order]
        begins = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        many = np.diff([*begins, len(every)]) > 1
        shared = np.repeat(many, np.diff([*begins, len(every)]))

        back, back_owner = every[shared], owner[shared]
        went = names.view(np.uint64) >> np.uint64(64 - self.bits)
        back_went = back_owner.view(np.uint64) >> np.uint64(64 - self.bits)
        for q in np.unique(went):
            mine = went == q
            got = back_went == q
            c, k, s = _grouped(back_owner[got], back[got])
            counts = np.zeros(mine.sum(), np.uint32)
            own = np.sort(names[mine])
            counts[np.searchsorted(own, c)] = k
            by_name = sizes[mine][np.argsort(names[mine])]
            yield int(q), int(q), own.tobytes(), counts.tobytes(), by_name.tobytes(), s.tobytes()

        # One posting for a shingle known to be shared, with class 0.
        once = np.concatenate([every[~shared], every[begins[many]]])
        holder = np.concatenate([owner[~shared], np.zeros(many.sum(), np.int64)])
        part = once >> np.uint64(64 - self.bits)
        order = np.lexsort((holder, part))
        once, holder, part = once[order], holder[order], part[order]
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        for a, b in zip(edges, [*edges[1:], len(part)]):
            c, k = np.unique(holder[a:b], return_counts=True)
            yield int(part[a]), None, c.tobytes(), k.astype(np.uint32).tobytes(), None, _six(once[a:b])


def _dealt(docs: DataFrame, text: str, bits: int, most: int = 1_000_000) -> DataFrame:
    names = ["part", "q", "cls", "counts", "sizes", "shingles"]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]

    def emitted(pack: Pack) -> Iterator[pa.RecordBatch]:
        for row in pack.rows():
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Pack(bits, most)
        for batch in slices(batches, "_text", SLICE):
            found, first = hashed_words(batch.column(0).to_pylist())
            for a, b in zip(first[:-1], first[1:]):
                if b > a:
                    pack.add(found[a:b])
                if pack.held > most:
                    yield from emitted(pack)
        if pack.held:
            yield from emitted(pack)

    return docs.select(text_of(text).alias("_text")).mapInArrow(deal, f"part int, {PACKED}")


def _shared_of(bits: int):
    def find(rows: pd.DataFrame) -> pd.DataFrame:
        names = ["q", "cls", "counts", "sizes", "shingles"]
        out = rows.loc[rows.q.notna(), names].astype({"q": "int64"}).values.tolist()
        posted = rows[rows.q.isna()]
        if not len(posted):
            return pd.DataFrame(out, columns=names)
        part = int(posted.part.iloc[0])
        every = np.concatenate([_from_six(s, part, bits) for s in posted.shingles])
        owner = np.concatenate(
            [np.repeat(np.frombuffer(c, np.int64), np.frombuffer(k, np.uint32)) for c, k in zip(posted.cls, posted.counts)]
        )
        order = np.argsort(every)
        every, owner = every[order], owner[order]
        begins = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        several = np.minimum.reduceat(owner, begins) != np.maximum.reduceat(owner, begins)
        keep = np.repeat(several, np.diff([*begins, len(every)])) & (owner != 0)
        c, k, s = _grouped(owner[keep], every[keep])
        went = c.view(np.uint64) >> np.uint64(64 - bits)
        ends = np.concatenate([[0], np.cumsum(k, dtype=np.int64)])
        for q in np.unique(went):
            i = np.flatnonzero(went == q)
            order = np.concatenate([s[ends[j] : ends[j + 1]] for j in i])
            out.append([int(q), c[i].tobytes(), k[i].tobytes(), None, order.tobytes()])
        return pd.DataFrame(out, columns=names)

    return find


def _needed(size: int, percent: int) -> int:
    return -(-size * percent // 100)


def _merged(bits: int, percent: int):
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        names = [np.frombuffer(c, np.int64) for c in rows.cls]
        owner = np.concatenate([np.repeat(c, np.frombuffer(k, np.uint32)) for c, k in zip(names, rows.counts)])
        # Shingles sent straight back have all their bits; keep the same ones of both kinds.
        top = np.uint64(((1 << bits) - 1) << (64 - bits)) | LOW
        every = np.concatenate([np.frombuffer(s, np.uint64) for s in rows.shingles]) & top
        known = [(c, np.frombuffer(s, np.uint32)) for c, s in zip(names, rows.sizes) if s is not None]
        size = dict(zip(np.concatenate([c for c, _ in known]).tolist(), np.concatenate([s for _, s in known]).tolist()))
        order = np.lexsort((every, owner))
        every, owner = every[order], owner[order]
        new = np.concatenate([[True], (every[1:] != every[:-1]) | (owner[1:] != owner[:-1])])[: len(every)]
        every, owner = every[new].view(np.int64), owner[new]
        cls = np.array(sorted(size), np.int64)
        a, b = np.searchsorted(owner, cls), np.searchsorted(owner, cls, side="right")
        sizes = [size[c] for c in cls.tolist()]
        kept = [every[x:y] if y - x >= _needed(n, percent) else every[:0] for x, y, n in zip(a, b, sizes)]
        return pd.DataFrame({"cls": cls, "n": sizes, "shared": kept})

    return merge


def adaptive_length(n: int, frequencies: np.ndarray, percent: int, most: int = 4) -> tuple[int, np.ndarray]:
    """The number of matches to ask for, and for each shared prefix shingle when it enters.

    ``frequencies`` belong to the shared shingles in order; the unique ones come before them.
    Asking for l matches reads the lists of the l-prefix and verifies at most (their total
    length) / l candidates, each at the cost of a set of size n.
    """
    lone = n - len(frequencies)
    plain = n - _needed(n, percent)
    reach = np.minimum(np.maximum(plain + np.arange(1, most + 1) - lone, 0), len(frequencies))
    lists = np.concatenate([[0], np.cumsum(frequencies)])[reach]
    asked = np.arange(1, min(most, _needed(n, percent)) + 1)
    best = int(np.argmin(lists[: len(asked)] * (1 + 0.1 * n / asked))) + 1
    enters = np.ones(reach[best - 1], np.int32)
    for extra in range(1, best):
        enters[reach[extra - 1] : reach[extra]] = extra + 1
    return best, enters


def _prefixes(ranked: DataFrame, percent: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for cls, n, shared, df in zip(*(batch.column(i).to_pylist() for i in range(4))):
                asked, enters = adaptive_length(n, np.array(df), percent)
                k = len(enters)
                rows = ([cls] * k, [n] * k, [len(df)] * k, [asked] * k, shared[:k], enters.tolist())
                for column, values in zip(out, rows):
                    column.extend(values)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
            names = ["cls", "n", "k", "asked", "h", "enters"]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names)

    schema = "cls long, n int, k int, asked int, h long, enters int"
    return ranked.select("cls", "n", "shared", "df").mapInArrow(cut, schema)


def _verified(pairs: DataFrame, ranked: DataFrame, percent: int) -> DataFrame:
    sets = ranked.select("cls", "n", "shared")
    left, right = (sets.select(*(F.col(c).alias(f"{c}_{s}") for c in sets.columns)) for s in "ab")
    both = F.size(F.array_intersect("shared_a", "shared_b"))
    return (
        pairs.select("cls_a", "cls_b")
        .join(left, "cls_a")
        .join(right, "cls_b")
        .withColumn("_both", both)
        .where(100 * F.col("_both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("_both")))
        .select("cls_a", "cls_b")
    )


def components(links: DataFrame, stage: Stage, name: str, a: str = "cls_a", b: str = "cls_b") -> DataFrame:
    """(node, comp) for every node of a link; comp is the smallest node it reaches.

    Each pass takes the smallest name among a node, its neighbours and their names, then
    follows names once; passes end when none changes.  Every pass is a table of its own.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    edges = stage.put(f"{name}_edges", both.union(both.select("other", "node")).distinct())
    names = stage.put(f"{name}_0", edges.groupBy("node").agg(F.least("node", F.min("other")).alias("comp")))
    turn = 0
    while True:
        turn += 1
        seen = names.select(F.col("node").alias("other"), F.col("comp").alias("_comp"))
        lowest = edges.join(seen, "other").groupBy("node").agg(F.min("_comp").alias("_low"))
        lower = names.join(lowest, "node").select("node", F.col("comp").alias("_was"), F.least("comp", "_low").alias("_at"))
        onward = names.select(F.col("node").alias("_at"), F.col("comp").alias("_next"))
        after = lower.join(onward, "_at").select("node", "_was", F.least("_at", "_next").alias("comp"))
        after = stage.put(f"{name}_{turn}", after)
        names = after.select("node", "comp")
        if after.where("comp <> _was").isEmpty():
            return names


def _relabelled(labels: DataFrame, links: DataFrame, stage: Stage, name: str) -> DataFrame:
    """Labels after links between members of different components."""
    of = lambda s: labels.select(F.col("cls").alias(f"cls_{s}"), F.col("comp").alias(f"comp_{s}"))
    merged = links.join(of("a"), "cls_a").join(of("b"), "cls_b").select("comp_a", "comp_b").distinct()
    found = components(merged, stage, name, "comp_a", "comp_b").withColumnRenamed("comp", "_to")
    moved = labels.join(found, labels.comp == found.node, "left")
    return stage.put(f"{name}_labels", moved.select("cls", F.coalesce("_to", "comp").alias("comp")))


def _fits(a: dict[str, Column], b: dict[str, Column], percent: int) -> Column:
    """Whether the sizes n, and the numbers k of shingles not alone, leave room for a link."""
    return (100 + percent) * F.least(a["k"], b["k"]) >= percent * (a["n"] + b["n"])


def _side(rows: DataFrame, s: str, *extra: str) -> DataFrame:
    return rows.select("h", *(F.col(c).alias(f"{c}_{s}") for c in ("cls", "n", "k", "comp", *extra)))


def _sized(s: str) -> dict[str, Column]:
    return {"n": F.col(f"n_{s}"), "k": F.col(f"k_{s}")}


def _links_in(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between the two blocks of a group, or inside its one block, that join components."""
    rows = rows.sort_values("cls", kind="stable").reset_index(drop=True)
    sizes = np.array([len(s) for s in rows.shared])
    n, cls, block = rows.n.to_numpy(), rows.cls.to_numpy(), rows.block.to_numpy()
    comp = np.unique(rows.comp.to_numpy(), return_inverse=True)[1]
    every = np.concatenate(list(rows.shared))
    owner = np.repeat(np.arange(len(rows)), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    apart = rows.i.iloc[0] != rows.j.iloc[0]
    out: list[tuple[int, int]] = []
    # Members of small components ask first; a component that has met all others is done.
    for x in np.argsort(np.bincount(comp)[comp], kind="stable"):
        others = comp != comp[x]
        if apart:
            others &= block != block[x]
        if not others.any():
            continue
        mine = np.asarray(rows.shared[x])
        a, b = np.searchsorted(every, mine), np.searchsorted(every, mine, side="right")
        length = b - a
        at = np.repeat(a - np.cumsum(length) + length, length) + np.arange(length.sum())
        both = np.bincount(owner[at], minlength=len(rows))
        for y in np.flatnonzero(others & (100 * both >= percent * (n + n[x] - both))):
            if comp[y] != comp[x]:
                comp[comp == comp[y]] = comp[x]
                out.append((cls[x], cls[y]))
    return pd.DataFrame(out, columns=["cls_a", "cls_b"], dtype="int64")


def _family_links(
    long: DataFrame, labels: DataFrame, ranked: DataFrame, stage: Stage, percent: int, per_block: int = 1000, shingles: int = 4_000_000
) -> DataFrame:
    """Links of classes that meet, directly or by others, in long lists."""
    hubs = long.groupBy("h").agg(F.min("cls").alias("cls_a"))
    meet = long.join(hubs, "h").select("cls_a", F.col("cls").alias("cls_b")).distinct()
    family = components(meet, stage, "family").select(F.col("node").alias("cls"), F.col("comp").alias("family"))
    members = ranked.select("cls", "n", "shared").join(family, "cls").join(labels, "cls")
    blocks = members.groupBy("family").agg(
        F.greatest(F.ceil(F.count("*") / per_block), F.ceil(F.sum(F.size("shared")) / shingles)).alias("blocks")
    )
    # A block meets each block of its family, itself included, once.
    meets = F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("other")
    paired = (
        members.join(blocks, "family")
        .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        .select("*", meets)
        .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        .drop("blocks", "other")
    )
    return paired.groupBy("family", "i", "j").applyInPandas(lambda rows: _links_in(rows, percent), "cls_a long, cls_b long")


def _linked(
    postings: DataFrame, ranked: DataFrame, stage: Stage, percent: int, rounds: int, short: int = 32
) -> DataFrame:
    labels = ranked.select("cls", F.col("cls").alias("comp"))

    def open_lists(name: str) -> DataFrame:
        """Postings of lists in which different components meet."""
        held = postings.join(labels, "cls")
        lists = held.groupBy("h").agg(F.count("*").alias("m"), F.min("comp").alias("_a"), F.max("comp").alias("_b"))
        return stage.put(name, held.join(lists.where("_a <> _b").select("h", "m"), "h"))

    for turn in range(rounds):
        still = open_lists(f"open_{turn}")
        lone = F.col("n") - F.col("k")
        best = F.struct(lone, F.xxhash64("cls", F.lit(turn)), "cls", "n", "k", "comp")
        hubs = still.groupBy("h").agg(F.min(best).alias("hub"))
        sized = {"n": F.col("hub.n"), "k": F.col("hub.k")}
        star = (
            still.join(hubs, "h")
            .where((F.col("comp") != F.col("hub.comp")) & _fits({"n": F.col("n"), "k": F.col("k")}, sized, percent))
            .select(F.col("hub.cls").alias("cls_a"), F.col("cls").alias("cls_b"))
            .distinct()
        )
        labels = _relabelled(labels, stage.put(f"links_{turn}", _verified(star, ranked, percent)), stage, f"round_{turn}")

    still = open_lists("open")
    asked = F.least("asked_a", "asked_b")
    few = still.where(F.col("m") <= short)
    pairs = (
        _side(few, "a", "asked", "enters")
        .join(_side(few, "b", "asked", "enters"), "h")
        .where("comp_a < comp_b")
        .where(_fits(_sized("a"), _sized("b"), percent) & (F.greatest("enters_a", "enters_b") <= asked))
    )
    # A pair with a match in a long list is of one family; all others have theirs here.
    pairs = (
        pairs.groupBy("cls_a", "cls_b")
        .agg(F.count("*").alias("matches"), F.first(asked).alias("asked"))
        .where("matches >= asked")
    )
    links = _verified(pairs, ranked, percent).unionByName(
        _family_links(still.where(F.col("m") > short), labels, ranked, stage, percent)
    )
    return _relabelled(labels, stage.put("links", links), stage, "last")


def similar(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    percent: int = PERCENT,
    rounds: int = 2,
    per_part: int = 2_000_000,
) -> DataFrame:
    """Key, n_shingles, cls (equal word sequences), comp and component_id per document.

    component_id is the smallest key among all documents that links reach.  NULL and blank
    texts have no shingles, link with nothing and are their own component.  Repeated rows and
    keys are documents like any other; a NULL key never is the smallest while there is one that
    is not.  An empty table gives no rows.  Names of classes have 64 bits and shingles 48 and
    the bits of the part; sizes count distinct shingles of 64 bits.
    """
    small_batches(docs.sparkSession)
    stage = Stage(docs.sparkSession)
    ids = stage.put("ids", classes(docs, text, [key]))
    total = ids.agg(F.sum("n_words")).first()[0] or 0
    bits = min(max(6, math.ceil(math.log2(max(total, 1) / per_part))), 20)
    back = _dealt(docs, text, bits).groupBy("part").applyInPandas(_shared_of(bits), PACKED)
    sets = stage.put("sets", back.groupBy("q").applyInPandas(_merged(bits, percent), "cls long, n int, shared array<bigint>"))

    rows = sets.where(F.size("shared") > 0).select("cls", "n", F.explode("shared").alias("h"))
    counts = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    ranked = stage.put(
        "ranked",
        rows.join(counts, "h")
        .groupBy("cls")
        .agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "h"))).alias("s"))
        .where(100 * F.size("s") >= percent * F.col("n"))
        .select("cls", "n", F.col("s.h").alias("shared"), F.col("s.df").alias("df")),
    )
    postings = stage.put("postings", _prefixes(ranked, percent))
    labels = _linked(postings, ranked, stage, percent, rounds)

    placed = ids.join(sets.select("cls", "n"), "cls", "left").join(labels, "cls", "left")
    placed = placed.withColumn("comp", F.coalesce("comp", "cls"))
    smallest = placed.groupBy("comp").agg(F.min(key).alias("_smallest"))
    return placed.join(smallest, "comp", "left").select(
        key,
        F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("n_shingles"),
        "cls",
        "comp",
        F.coalesce("_smallest", key).alias("component_id"),
    )


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component: the smallest key, NULL last.

    Documents without words are all kept, for they are like nothing.  Of repeated rows that are
    chosen one is kept.  Columns of any name are handed through.
    """
    docs, names = set_aside(docs)
    text, key = new_name(names, text), new_name(names, key)
    stage = Stage(docs.sparkSession)
    found = stage.put("found", similar(docs, text, key, percent).where("cls IS NOT NULL"))
    best = F.min(F.struct(F.col(key).isNull(), F.col(key).alias("key"), "cls")).alias("best")
    chosen = found.groupBy("comp").agg(best).select(F.col("best.key").alias("_key"), F.col("best.cls").alias("_cls"))
    again = found.groupBy(key, "cls").count().where("count > 1").isEmpty()
    columns = docs.columns
    named = classes(docs, text, columns).toDF(*columns, "_named", "_words")
    kept = named.join(chosen, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_named") == F.col("_cls")), "left_semi")
    if not again:
        kept = kept.dropDuplicates([key, "_named"])
    return kept.union(named.where(F.col("_named").isNull())).select(*given_back(names))
