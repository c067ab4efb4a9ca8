"""Rows the tests of this folder share, and plain versions of what they check."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice("aeiou") + "".join(rng.choices("bcdlmnrst", k=3)) for _ in range(n))


def documents(spark, texts, sources=("a", "b", None)):
    """Documents with the ids 0, 1, ... or, for a pair, the id it names."""
    rows = []
    for i, t in enumerate(texts):
        key, text = t if isinstance(t, tuple) else (i, t)
        rows.append((key, text, "en", sources[i % len(sources)], len(text or "")))
    return spark.createDataFrame(rows, DOCS)


# Texts that operators must live with: NULL, blank, very long, repeated, and odd characters.
ODD = [None, "", " \t\n", "é ß 日本  x", "x " * 30_000, "Same TEXT here", "Same TEXT here", (5, "Same TEXT here"), (None, "no id")]
