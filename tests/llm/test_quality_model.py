import zlib

import numpy as np
import pytest
from helpers import ODD, documents, prose
from orderflow.llm import quality


def junk(i):
    return prose(i, 90).upper().replace(" ", "!! ") if i % 2 else " ".join(w for w in prose(i, 9).split() for _ in range(12))


def labelled(spark, n=240):
    texts = [junk(i) if i % 3 == 0 else prose(i, 40 + i) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(n)], "doc_id long, quality int, toxic int")
    return documents(spark, texts), labels


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = labelled(spark)
    return quality.fit(docs, labels)


def test_held_out_accuracy(spark, trained):
    docs, labels = labelled(spark)
    scored = quality.score(docs, trained).join(labels, "doc_id").collect()
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 40
    assert sum((r.score >= 0.5) == r.quality for r in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 for r in scored)


def test_attention_finds_the_bad_passage(trained):
    """A long text with one junk passage scores below the same text without."""
    clean = prose(1000, 640)
    x, rows = quality.encode([clean, clean[: len(clean) // 2] + " " + junk(1001) + " " + clean[len(clean) // 2 :]])
    good, mixed = trained.score(x, rows)
    assert mixed < good


def test_labels_of_held_out_documents_are_not_used(spark, trained):
    docs, labels = labelled(spark)
    turned = labels.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS STRING)) % 3 = 1, 1 - quality, quality) AS quality")
    again = quality.fit(docs.repartition(5), turned.repartition(3))
    assert all(np.array_equal(again.weights[k], v) for k, v in trained.weights.items())


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    rows, y = np.array([0, 3, 4, 9]), np.array([1.0, 0.0, 1.0])
    x = rng.normal(size=(9, 5))
    shapes = {"W": (5, 4), "Wb": (4,), "V": (4, 3), "U": (4, 3), "w": (3,), "c": (4,), "b": (1,)}
    model = quality.Model(np.zeros(5), np.ones(5), {k: rng.normal(size=s) for k, s in shapes.items()})

    def loss():
        p = model.score(x, rows)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, gradient in model.gradients(x, rows, y).items():
        at = model.weights[name].reshape(-1)
        for i in range(len(at)):
            kept = at[i]
            at[i] = kept + 1e-6
            up = loss()
            at[i] = kept - 1e-6
            down = loss()
            at[i] = kept
            assert (up - down) / 2e-6 == pytest.approx(np.ravel(gradient)[i], abs=1e-6), name


def test_odd_texts_clashes_and_missing_labels(spark, trained):
    docs = documents(spark, ODD).selectExpr("*", "'x' AS Score")
    scored = quality.score(docs, trained)
    assert scored.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
    rows = scored.collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert len({round(r.score, 6) for r in rows if not (r.text or "").strip()}) == 1
    assert quality.score(documents(spark, []), trained).count() == 0
    one_kind = spark.createDataFrame([(0, 1), (None, 0), (2, None)], "doc_id long, quality int")
    assert quality.fit(documents(spark, ODD), one_kind) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}


def test_passages_do_not_depend_on_the_batch():
    texts = [prose(i, 30 * i) for i in range(1, 9)] + [None, "", " x "]
    together, rows = quality.encode(texts)
    for i, text in enumerate(texts):
        alone, _ = quality.encode([text])
        assert np.allclose(alone, together[rows[i] : rows[i + 1]])
