"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages.  Every passage is encoded from what its characters and words
look like; a gated attention network, learned from document labels alone, weighs the passages,
and the weighted representation is scored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.llm.common import IS_SPACE, doc_crc, hashed_words, slices, small_batches, text_of, without, word_count
from orderflow.session import Stage

PASSAGE = 64
# Kinds of bytes: space, line end, lower, upper, digit, a kind per common mark, other marks, rest.
KINDS = np.full(256, 5, np.uint8)
KINDS[0x80:] = 6
for _code, _bytes in enumerate((b" \t\r\v\f", b"\n", bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)))):
    KINDS[list(_bytes)] = _code
for _code, _mark in enumerate(b".,!?|*#&$%-:", 7):
    KINDS[_mark] = _code
N_KINDS = 19
LEXICAL = 64
WIDTH = N_KINDS * N_KINDS + LEXICAL + 3


def encode(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A row per passage of 64 words, and each text's first row; a text has one row at least.

    The row holds square roots of the shares of neighbouring kinds of bytes and of hashed
    words, the share of words equal to the one before, the share of distinct words, and the
    passage's length.
    """
    raw = [b" " + (t or "").encode() + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    of_text = np.repeat(np.arange(len(texts)), [len(r) for r in raw])
    hashes, first = hashed_words(texts)
    counts = np.diff(first)
    passages = np.maximum(-(-counts // PASSAGE), 1)
    rows = np.concatenate([[0], np.cumsum(passages)])
    total = rows[-1]
    out = np.zeros((total, WIDTH), np.float32)

    doc = np.repeat(np.arange(len(texts)), counts)
    row = rows[doc] + (np.arange(len(hashes)) - first[doc]) // PASSAGE
    # The row of a byte is that of the word it is in or after, or its text's first.
    kinds = KINDS[data].astype(np.int64)
    space = IS_SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    word = np.cumsum(begins) - 1
    of_byte = rows[of_text]
    after = word >= first[of_text]
    of_byte[after] = row[word[after]]
    inside = of_text[1:] == of_text[:-1]
    pairs = (of_byte[1:] * N_KINDS**2 + kinds[:-1] * N_KINDS + kinds[1:])[inside]
    shares = np.bincount(pairs, minlength=total * N_KINDS**2).reshape(total, -1)
    out[:, : N_KINDS**2] = np.sqrt(shares / np.maximum(shares.sum(1, keepdims=True), 1))
    if len(row):
        size = np.maximum(np.bincount(row, minlength=total), 1)
        bucket = (hashes >> np.uint64(58)).astype(np.int64)
        lexical = np.bincount(row * LEXICAL + bucket, minlength=total * LEXICAL).reshape(total, -1)
        out[:, N_KINDS**2 : -3] = np.sqrt(lexical / size[:, None])
        again = np.zeros(len(row))
        again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        out[:, -3] = np.bincount(row, again, total) / size
        order = np.lexsort((hashes, row))
        new = np.ones(len(row))
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
        out[:, -2] = np.bincount(row[order], new, total) / size
        out[:, -1] = np.bincount(row, minlength=total) / PASSAGE
    return out, rows


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    """Weights of encoder (W), gated attention (V, U, w) and score (c, b), and the input's scale."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def _passes(self, x: np.ndarray, rows: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        h = np.tanh(x @ p["W"] + p["Wb"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (v * u) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, rows[:-1]), np.diff(rows)))
        a = e / np.repeat(np.add.reduceat(e, rows[:-1]), np.diff(rows))
        z = np.add.reduceat(a[:, None] * h, rows[:-1])
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "score": _sigmoid(z @ p["c"] + p["b"])}

    def score(self, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self._passes((x - self.mean) * self.scale, rows)["score"]

    def gradients(self, x: np.ndarray, rows: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, s = self.weights, self._passes(x, rows)
        n = np.diff(rows)
        d = (s["score"] - y) / len(y)
        dz = np.repeat(d, n)[:, None] * p["c"]
        through = (dz * s["h"]).sum(1)
        mean = np.add.reduceat(s["a"] * through, rows[:-1])
        de = s["a"] * (through - np.repeat(mean, n))
        dvu = de[:, None] * p["w"]
        dv, du = dvu * s["u"] * (1 - s["v"] ** 2), dvu * s["v"] * s["u"] * (1 - s["u"])
        dh = s["a"][:, None] * dz + dv @ p["V"].T + du @ p["U"].T
        dw = dh * (1 - s["h"] ** 2)
        return {
            "W": x.T @ dw, "Wb": dw.sum(0), "V": s["h"].T @ dv, "U": s["h"].T @ du,
            "w": (s["v"] * s["u"]).T @ de, "c": s["z"].T @ d, "b": d.sum(keepdims=True),
        }


def train(
    x: np.ndarray, rows: np.ndarray, y: np.ndarray, share: float, units: int = 32, epochs: int = 30, seed: int = 3
) -> Model:
    """Fit by Adam on bags; ``share`` is the share of label 1 among all labels.

    The bags may hold the labels in other shares; the bias is set right for ``share`` afterwards.
    """
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), 1 / (x.std(0) + 0.05)
    shapes = {"W": (x.shape[1], units), "Wb": (units,), "V": (units, 16), "U": (units, 16), "w": (16,), "c": (units,), "b": (1,)}
    weights = {k: rng.normal(0, (0.5 / max(s[0], 1)) ** 0.5, s).astype(np.float32) for k, s in shapes.items()}
    model = Model(mean, scale, weights)
    x = (x - mean) * scale
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for begin in range(0, len(y), 128):
            bags = order[begin : begin + 128]
            take = np.concatenate([np.arange(rows[i], rows[i + 1]) for i in bags])
            edges = np.concatenate([[0], np.cumsum(rows[bags + 1] - rows[bags])])
            step += 1
            for k, g in model.gradients(x[take], edges, y[bags]).items():
                g = g + 1e-4 * weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                rate = 0.01 * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                weights[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    held = np.clip(y.mean(), 0.01, 0.99)
    wanted = np.clip(share, 0.01, 0.99)
    weights["b"] = weights["b"] + np.float32(np.log(wanted / (1 - wanted)) - np.log(held / (1 - held)))
    return model


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    label: str = "quality",
    most_per_label: int = 1500,
    most_passages: int = 20_000,
) -> Model | None:
    """A model from labelled documents that are not held out (crc32 of the key, mod 3, is 1).

    The training sample is bounded: ``most_per_label`` documents of each label, the first by a
    hash of the key, as many as begin within the first ``most_passages`` passages.  Each of
    them is learned from whole, and every other use of the model covers whole texts.  A key with
    several labels takes the largest, repeated rows of a key count once, with the smallest of
    their texts.  None without labels of both kinds, as for empty tables.
    """
    small_batches(docs.sparkSession)
    usable = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (doc_crc(key) % 3 != 1))
        .groupBy(key)
        .agg(F.max(label).cast("int").alias("_label"))
    )
    shares = {r[0]: r[1] for r in usable.groupBy("_label").count().collect()}
    if set(shares) != {0, 1}:
        return None
    dice = F.md5(F.col(key).cast("string"))
    drawn = [usable.where(F.col("_label") == v).orderBy(dice, key).limit(most_per_label) for v in (0, 1)]
    sample = drawn[0].union(drawn[1])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 1 << 20):
            x, rows = encode(batch.column("_text").to_pylist())
            kept = [x[a:b].astype(np.float16).tobytes() for a, b in zip(rows[:-1], rows[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.binary())], ["k", "y", "x"])

    # At most twice most_per_label rows; repeated rows are brought together before the shuffle.
    chosen = Stage(docs.sparkSession).put(
        "sample",
        docs.select(F.col(key), text_of(text).alias("_text"))
        .join(F.broadcast(sample), key)
        .groupBy(F.md5(F.col(key).cast("string")).alias("k"), "_label")
        .agg(F.min("_text").alias("_text")),
    )
    earlier = Window.partitionBy("_label").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    passages = F.greatest(F.ceil(word_count("_text") / PASSAGE), F.lit(1))
    begun = chosen.select("k", F.coalesce(F.sum(passages).over(earlier), F.lit(0)).alias("before")).where(F.col("before") < most_passages)
    chosen = chosen.join(F.broadcast(begun.select("k")), "k").select("k", "_label", "_text").mapInArrow(features, "k string, y int, x binary")
    found = sorted((r.k, r.y, bytes(r.x)) for r in chosen.collect())
    if {y for _, y, _ in found} != {0, 1}:
        return None
    bags = [np.frombuffer(x, np.float16).reshape(-1, WIDTH).astype(np.float32) for _, _, x in found]
    rows = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    y = np.array([y for _, y, _ in found], np.float32)
    return train(np.concatenate(bags), rows, y, shares[1] / sum(shares.values()))


def score(
    docs: DataFrame, model: Model | None, text: str = "text", column: str = "score", keep: Sequence[str] | None = None
) -> DataFrame:
    """``docs`` with a score per whole text; 0.5 where there is no model.

    NULL and blank texts are one passage without words.  A column named like the new one is
    replaced; all others, or those in ``keep``, are handed through.
    """
    base = without(docs, column)
    keep = list(base.columns if keep is None else keep)
    if model is None:
        return base.select(*keep).withColumn(column, F.lit(0.5))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 1 << 20):
            x, rows = encode(batch.column(text).to_pylist())
            scores = shared.value.score(x, rows).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores)], [*keep, column])

    kinds = [*(base.schema[c] for c in keep), T.StructField(column, T.DoubleType())]
    return base.select(*dict.fromkeys([*keep, text])).mapInArrow(rate, T.StructType(kinds))
