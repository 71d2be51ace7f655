"""Repeated strings against a brute-force version over all places."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from tarnkit.llm import suffix_dedup

from .conftest import prose


def plain(texts):
    data = [(x or "").encode() for x in texts]
    counts = Counter(d[k:k + 200] for d in data for k in range(len(d) - 199))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, int)
        for k in range(len(d) - 199):
            if counts[d[k:k + 200]] > 1:
                gone[k:k + 200] = 1
        kept = bytes(np.frombuffer(d, np.uint8)[gone[:-1] == 0])
        out.append((len(d), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    return out


def check(frame):
    rows = frame.select("doc_id", "text").collect()
    wanted = [(r["doc_id"], *x[:4]) for r, x in zip(rows, plain([r["text"] for r in rows]))]
    assert sorted(map(tuple, suffix_dedup.dedup(frame).collect()), key=str) == sorted(wanted, key=str)


def test_documents(documents):
    check(documents)


@pytest.mark.parametrize("chunk", [1 << 20, 700])
def test_passages_edits_and_low_variety(spark, monkeypatch, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    passage, draw = prose(1, 90), np.random.default_rng(2)
    texts = [prose(10 + k, 40) + passage[:int(draw.integers(195, 400))] + prose(50 + k, 30) for k in range(12)]
    texts += [passage[a:a + n] for a, n in ((0, 199), (0, 200), (1, 200), (3, 201), (57, 330))]
    texts += ["ab" * 160, "b" + "ab" * 130, "x" * 250, "x" * 199, "é" * 130, "y" + "é" * 100, prose(99, 50) * 3]
    for k in range(30):
        body = list(prose(7, 200))
        for at in draw.integers(0, len(body), k % 4):
            body[at] = "#"
        texts.append("".join(body))
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))


def test_texts_without_repeats(spark):
    texts = [prose(1, 100), prose(1, 100) + prose(2, 80), "é" * 150 + "a", "a" + "é" * 150, None, "short"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["text"] for r in suffix_dedup.without_repeats(frame).collect()}
    for k, x in enumerate(plain(texts)):
        assert found[k] == (None if texts[k] is None else x[4].decode(errors="ignore"))


def test_no_documents(no_documents):
    assert suffix_dedup.dedup(no_documents).count() == 0
    assert suffix_dedup.without_repeats(no_documents).columns == no_documents.columns
