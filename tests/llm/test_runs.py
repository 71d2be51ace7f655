"""Periodic runs against all periods tried one by one."""

import random
from hashlib import sha256
from zlib import crc32

import numpy as np

from tarnkit.llm import runs
from tarnkit.llm.simhash import WORD


def plain_runs(x):
    """(start, end, period) of every run, from the stretches where symbols some way apart are equal."""
    least = {}
    for q in range(1, len(x) // 2 + 1):
        start = None
        for t in range(len(x) - q + 1):
            equal = t < len(x) - q and x[t] == x[t + q]
            if equal and start is None:
                start = t
            elif not equal and start is not None:
                if t + q - start >= max(12, 2 * q):
                    least.setdefault((start, t + q), q)
                start = None
    return sorted((a, b, q) for (a, b), q in least.items())


def found(x):
    return sorted(tuple(map(int, row)) for row in zip(*runs.periodic_runs(np.array(x, np.int64))))


def random_symbols(draw):
    n = draw.choice([0, 1, 11, 12, 13, 20, 40, 80, 150, 300])
    x = [draw.randrange(draw.choice([1, 2, 2, 3, 5, 50])) for _ in range(n)]
    for _ in range(draw.randrange(4) if n else 0):
        a, p, length = draw.randrange(n), draw.randint(1, max(1, n // 3)), draw.randint(1, n)
        for k in range(a, min(n, a + length)):
            x[k] = x[a + (k - a) % p]
    return x


def test_random_symbols():
    draw = random.Random(5)
    for _ in range(400):
        x = random_symbols(draw)
        assert found(x) == plain_runs(x), x


def test_nested_periods_and_broken_runs():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    assert found(b[:400]) == plain_runs(b[:400])
    ones = [0] * 300
    for k in (50, 51, 130, 200, 270):
        ones[k] = k
    assert found(ones) == plain_runs(ones)
    block = [1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2] * 9
    assert found(block) == plain_runs(block)
    assert found([0] * 5000) == [(0, 5000, 1)]


def plain_row(key, text):
    words = WORD.findall((text or "").encode())
    h, n = crc32(("" if key is None else str(key)).encode()), len(words)
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    rows = [(s, e - s, q) for s, e, q in plain_runs(words)]
    rows.sort(key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in rows for i in range(s + q, s + length)}
    best = min(rows, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in rows)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    first = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (key, len(rows), *first, sha256(listed.encode()).hexdigest(), sha256(kept).hexdigest())


def test_documents(documents):
    """Short texts against the plain version; the very long one has a row of its own kind."""
    rows = [tuple(r) for r in runs.runs(documents, periodic_tails=True).collect()]
    plain = [plain_row(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect() if len(r["text"] or "") < 20_000]
    assert sorted((r for r in rows if r[0] != 8), key=str) == sorted(plain, key=str)
    assert sum(r[0] == 8 for r in rows) == 1
    assert any(r[1] for r in rows) and any(not r[1] for r in rows)


def test_texts_of_a_batch_stay_apart(spark, monkeypatch):
    """Equal words at the seam of two texts make no run; pieces of any size give the same rows."""
    texts = ["w " * 8, "w " * 8, "a b c " * 7, "a b c " * 2, "", None, "x " + "y z " * 30]
    frame = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").repartition(1)
    whole = sorted(tuple(r) for r in runs.runs(frame).collect())
    assert [r[1] for r in whole] == [0, 0, 1, 0, 0, 0, 1] and whole[2][2:6] == (0, 21, 3, 7000)
    monkeypatch.setattr(runs, "WORDS_AT_ONCE", 1)
    assert sorted(tuple(r) for r in runs.runs(frame).collect()) == whole


def test_no_documents(no_documents):
    assert runs.runs(no_documents).count() == 0
