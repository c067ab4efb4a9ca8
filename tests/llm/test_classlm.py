import math
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from helpers import ODD, documents, prose, words
from pyspark.sql import functions as F

from orderflow.llm import classlm

SMALL = {"frequent": 20, "families": 8, "classes": 6, "listed": 40}


def held(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 7 == 2


def base_of(rows):
    lines = [(k, [*words(t), None]) for k, t in rows]
    counts = Counter(w for k, line in lines if not held(k) for w in line)
    n, v = sum(counts.values()), len(counts)
    return sorted(
        (str(k), len(line), sum(counts[w] > 0 for w in line), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in line))
        for k, line in lines
    )


def scored(docs, **options):
    return classlm.scored(docs, **(SMALL | options)).collect()


def check(spark, rows):
    found = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in scored(documents(spark, rows)))
    for a, b in zip(found, base_of(rows), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4])


def test_counts_and_base(spark):
    check(spark, [(i, prose(i, 5 + i % 60) + (" The THE the" if i % 2 else "")) for i in range(120)])


def test_odd_texts_and_ids(spark):
    check(spark, [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(ODD)])
    assert scored(documents(spark, [])) == []


def test_no_training_documents(spark):
    key = next(i for i in range(100) if held(i))
    row = scored(documents(spark, [(key, "a b c")]))[0]
    assert (row.train_tokens, row.n_known, row.base_score) == (0, 0, 0) and row.score <= 0


def test_probabilities_of_all_words_sum_to_one(spark):
    """Over all known words, the end, and one unknown word per class, after any class."""
    docs = documents(spark, [prose(i % 9, 20) for i in range(30)])
    texts = docs.selectExpr("text AS _text")
    counts = classlm.word_counts(texts, 8)
    model = classlm.fit(counts, texts, 20, 8, 6, 1000)
    units = classlm._numbered(model.words, model.frequent, model.families)
    share = np.zeros(6)
    np.add.at(share, model.unit_class[units], model.counts + 1.0)
    share[model.unit_class[-1]] += model.ends + 1
    share += 1
    for before in range(6):
        assert (10 ** model.transitions[before] * share / 10**model.emission).sum() == pytest.approx(1)


def test_the_model_beats_the_base_on_held_out_texts_of_two_kinds(spark):
    left, right = prose(1, 40).split(), prose(2, 40).split()
    rng = np.random.default_rng(0)
    docs = documents(spark, [" ".join(rng.choice(left if i % 2 else right, 30)) for i in range(200)])
    rows = [r for r in scored(docs, frequent=60, listed=100) if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert all(r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) for r in rows)


def likelihood(bigrams, label, classes):
    member = np.eye(classes)[label]
    table = member.T @ bigrams @ member
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return f(table) - f(table.sum(0)) - f(table.sum(1))


def test_exchange_never_ends_where_one_move_would_help():
    rng = np.random.default_rng(5)
    bigrams = rng.poisson(2, (9, 9)) * rng.integers(0, 3, (9, 9))
    bigrams[-1], bigrams[:, -1] = bigrams[:, -1].copy(), bigrams[-1].copy()
    bigrams = (bigrams + bigrams.T).astype(np.int64)
    label = classlm.exchange(bigrams, 4, sweeps=50)
    assert label[-1] == 0 and (label[:-1] > 0).all()
    best = likelihood(bigrams, label, 4)
    for unit, to in product(range(8), range(1, 4)):
        moved = label.copy()
        moved[unit] = to
        if bigrams[unit].sum():
            assert likelihood(bigrams, moved, 4) <= best + 1e-6


def test_bigrams_cover_every_neighbour(spark):
    docs = documents(spark, ["b a b", None, "a c"]).selectExpr("coalesce(text, '') AS _text")
    found = classlm.unit_bigrams(docs.repartition(3), [b"a", b"b"], 1)
    end = 3
    wanted = np.zeros((4, 4), int)
    for a, b in [(end, 1), (1, 0), (0, 1), (1, end), (end, end), (end, 0), (0, 2), (2, end)]:
        wanted[a, b] += 1
    # Texts of one task follow each other over the end; so do the task's first and last.
    assert found.sum() == wanted.sum() and (found == wanted).all()


def plain_scores(rows, core, enough, alpha=0.5):
    """The scores by dictionaries and loops, from the classes of the core's units."""
    classes, end = len(core.transitions), None
    frequent = {w.decode(): int(c) for w, c in zip(core.words[: core.frequent], core.unit_class)}
    endings = core.unit_class[core.frequent : -1]

    def start(w):
        return 0 if w is end else frequent.get(w, int(endings[zlib.crc32(w.encode()[-3:]) % core.families]))

    lines = {k: [end, *words(t), end] for k, t in rows}
    train = [line for k, line in lines.items() if not held(k)]
    counts = Counter(w for line in train for w in line[1:])
    worth = {w: np.zeros(classes) for w in counts if w not in frequent and w is not end and counts[w] >= enough}
    for line in train:
        for before, w, after in zip(line, line[1:], line[2:]):
            if w in worth:
                worth[w] += core.transitions[start(before)] + core.transitions[:, start(after)] - core.emission
    own = {w: 1 + int(np.argmax(np.round(v[1:], 6))) for w, v in worth.items()}

    def label(w):
        return own.get(w, start(w))

    table = Counter((label(a), label(b)) for line in train for a, b in zip(line, line[1:]))
    begun, ended = Counter(), Counter()
    for (a, b), n in table.items():
        begun[a] += n
        ended[b] += n
    kinds = Counter(label(w) for w in counts)

    def step(a, w):
        b = label(w)
        share = (table[a, b] + alpha) / (begun[a] + alpha * classes)
        return math.log10(share) + math.log10((counts[w] + 1) / (ended[b] + kinds[b] + 1))

    return {k: sum(step(label(a), w) for a, w in zip(line, line[1:])) for k, line in lines.items()}, own


@pytest.mark.parametrize(("enough", "listed"), [(1, 20), (3, 60), (3, 10_000), (10**6, 60)])
def test_scores_are_those_of_a_plain_version(spark, enough, listed):
    rng = np.random.default_rng(7)
    rows = [(i, f"{prose(i % 11, 5 + i % 40)} w{int(rng.zipf(1.5)) % 300} seen{i}") for i in range(150)]
    rows += [(150 + i, x) for i, x in enumerate([None, "", " \t ", "new words only", "THE the"])]
    docs = documents(spark, rows).repartition(3)
    training = docs.where(~(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2))
    texts = training.selectExpr("coalesce(text, '') AS _text")
    core = classlm.fit(classlm.word_counts(texts, 8), texts, 20, 8, 6, listed)
    wanted, own = plain_scores([(k, t or "") for k, t in rows], core, enough)
    assert bool(own) == (enough < 10**6)
    found = {r.doc_id: r.score for r in scored(docs, listed=listed, enough=enough)}
    assert found == {k: pytest.approx(v, abs=1e-8) for k, v in wanted.items()}


def test_words_of_one_use_move_to_one_class_whatever_their_ending(spark):
    """Many rare names in one place, many rare verbs in another: endings mix them, neighbours part them."""
    rng = np.random.default_rng(3)
    lines = [f"the n{rng.integers(200)}q of a town v{rng.integers(200)}q it well" for _ in range(3000)]
    texts = documents(spark, lines).selectExpr("text AS _text")
    counts = classlm.word_counts(texts, 4)
    core = classlm.fit(counts, texts, 7, 4, 8, 1000)
    near = classlm.neighbour_classes(texts.repartition(4), core, classlm._hopeful(counts, 3), most=500)
    own = {r.word: r["class"] for r in classlm.own_classes(near, core, 3).collect()}
    names, verbs = {own[w] for w in own if w[0] == "n"}, {own[w] for w in own if w[0] == "v"}
    assert len(own) > 390 and len(names) == len(verbs) == 1 and names != verbs


def test_columns_of_any_name(spark):
    names = ["_key", "_text", "row", "labels", "rare", "word", "joined", "score", "held_out"]
    docs = documents(spark, [prose(i, 20) for i in range(30)])
    more = docs.select("*", *(F.lit("x").alias(n) for n in names))
    assert sorted(scored(more)) == sorted(scored(docs))
