"""Counts and base scores against a plain version; the model's probabilities and what it learns."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tarnkit.llm import lm

from .conftest import prose


def plain_base(rows):
    tokens = [(k, zlib.crc32(("" if k is None else str(k)).encode()) % 10 == 0,
               [*re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or "")), None]) for k, x in rows]
    counts = Counter(w for _, held, words in tokens if not held for w in words)
    n, v = sum(counts.values()), len(counts)
    return [(k, held, len(words), sum(counts[w] > 0 for w in words), n,
             round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), 6)) for k, held, words in tokens]


@pytest.mark.parametrize("listed", [150_000, 20])
def test_documents(documents, monkeypatch, listed):
    monkeypatch.setattr(lm, "LISTED", listed)
    found = lm.score(documents).collect()
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    wanted = sorted(plain_base(rows), key=str)
    got = sorted(((*(r[c] for c in names), round(r["base_score"], 6)) for r in found), key=str)
    assert [x[:-1] for x in got] == [x[:-1] for x in wanted]
    assert all(math.isclose(a[-1], b[-1], rel_tol=1e-9, abs_tol=1e-5) for a, b in zip(got, wanted))
    assert all(r["score"] < 0 for r in found)


def test_list_and_join_give_the_same_scores(spark, monkeypatch):
    draw = np.random.default_rng(1)
    words = [f"w{k}" for k in range(900)]
    rare = 1 / np.arange(1, 901)
    texts = [(k, " ".join(draw.choice(words, 100, p=rare / rare.sum()))) for k in range(150)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    scores = []
    for listed in (150_000, 400):
        monkeypatch.setattr(lm, "LISTED", listed)
        scores.append({r["doc_id"]: r["score"] for r in lm.score(frame).collect()})
    assert scores[0].keys() == scores[1].keys()
    assert all(math.isclose(scores[0][k], scores[1][k], rel_tol=1e-5) for k in scores[0])


def test_probabilities_sum_to_one():
    model = lm.Model(np.arange(lm.UNITS))
    model.out += np.random.default_rng(2).normal(0, 1, model.out.shape).astype(np.float32)
    context = np.tile([[3, 8, 200]], (lm.UNITS, 1))
    assert math.isclose(np.exp(model.log_probabilities(context, np.arange(lm.UNITS))).sum(), 1, rel_tol=1e-5)


def test_shares_of_a_unit_sum_to_one():
    words = [(f"w{k}".encode(), k + 1) for k in range(600)]
    classes = {}
    for w, n in words:
        a, b = classes.get(lm.class_of(w), (0, 0))
        classes[lm.class_of(w)] = (a + n, b + 1)
    vocabulary = lm.Vocabulary(words, 10, classes)
    shares = np.bincount(vocabulary.unit, 10 ** vocabulary.share, lm.UNITS)
    unknown = np.where(vocabulary.kinds > 0, lm.ADDED / vocabulary.whole(), 0)
    used = vocabulary.kinds > 0
    used[:lm.OWN + 1] = False
    assert np.allclose((shares + unknown)[used], 1)


def test_training_beats_the_unigram_on_ordered_text(spark):
    texts = [(k, " ".join(["the cat sat on a mat", "one two three four five six"][(k + i) % 2] for i in range(20))) for k in range(400)]
    found = [r for r in lm.score(spark.createDataFrame(texts, "doc_id long, text string")).collect() if r["held_out"]]
    assert len(found) > 10 and sum(r["score"] for r in found) > 0.8 * sum(r["base_score"] for r in found)


def test_contexts():
    context, flat = lm.contexts([np.array([1, 2, lm.END]), np.array([lm.END]), np.array([4, lm.END])])
    assert flat.dtype == np.int64 and flat.tolist() == [1, 2, lm.END, lm.END, 4, lm.END]
    e = lm.END
    assert context.tolist() == [[e, e, e], [1, e, e], [2, 1, e], [e, e, e], [e, e, e], [4, e, e]]


def test_no_documents(no_documents):
    assert lm.score(no_documents).count() == 0
