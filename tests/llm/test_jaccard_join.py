"""Jaccard join against all pairs of sets, and its parts."""

import random

import numpy as np
import pytest

from tarnkit.llm import jaccard_join
from tarnkit.llm.simhash import WORD

from .conftest import prose


def plain(rows):
    """(key, set size, smallest key reachable) by comparing all pairs."""
    sets = []
    for key, text in rows:
        words = [w.decode().lower() if w.isascii() else w for w in WORD.findall((text or "").encode())]
        width = min(3, len(words))
        sets.append({tuple(words[k:k + width]) for k in range(len(words) - width + 1)} if words else set())
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 10 * both >= 9 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for k, (key, _) in enumerate(rows):
        if key is not None:
            least[top(k)] = min(least.get(top(k), key), key)
    return sorted(((key, len(s), least.get(top(k)) if s else key) for k, ((key, _), s) in enumerate(zip(rows, sets))), key=str)


def edited(draw, words, edits):
    out = list(words)
    for _ in range(edits):
        k = draw.randrange(len(out))
        out[k:k + draw.choice([0, 1, 1, 2])] = [prose(draw.randrange(10**6), 1)]
    return out


def near_copies(seed):
    """Texts of many sizes whose copies differ in so many words that their similarities lie on both sides of the limit."""
    draw, rows = random.Random(seed), []
    for base in range(14):
        words = prose(100 * seed + base, draw.choice([3, 9, 12, 25, 60, 90, 150, 400])).split(" ")
        for _ in range(draw.choice([1, 3, 12])):
            rows.append(" ".join(edited(draw, words, draw.randint(0, 1 + len(words) // 45))))
    template = prose(seed, 200).split(" ")
    rows += [" ".join(template[:120] + prose(10**7 + k, 60).split(" ") + template[120:]) for k in range(25)]
    chain = prose(seed + 7, 300).split(" ")
    for k in range(12):
        chain = edited(draw, chain, 3)
        rows.append(" ".join(chain).upper() if k % 3 else " ".join(chain))
    draw.shuffle(rows)
    return list(enumerate(rows, 10))


@pytest.mark.parametrize("seed", [1, 2])
def test_all_links_are_found(spark, seed):
    rows = near_copies(seed)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = plain(rows)
    assert sorted(map(tuple, jaccard_join.join(frame).collect()), key=str) == expected
    assert 30 < len({r[2] for r in expected}) < len(rows)


def test_large_regions_in_blocks_and_rounds(spark, monkeypatch):
    """One group of near copies that is larger than a region may be, in blocks, with a bound that takes several rounds."""
    draw, words = random.Random(5), prose(77, 250).split(" ")
    rows = [(k, " ".join(edited(draw, words, draw.randint(1, 6)))) for k in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(jaccard_join, "REGION", 30)
    monkeypatch.setattr(jaccard_join, "LEAF", 8)
    assert sorted(map(tuple, jaccard_join.join(frame).collect()), key=str) == plain(rows)


def test_documents(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    assert sorted(map(tuple, jaccard_join.join(documents).collect()), key=str) == plain(rows)


def test_no_documents(no_documents):
    assert jaccard_join.join(no_documents).count() == 0


def test_recursive_regions_lose_no_pair():
    """Voronoi regions with windows find all pairs that the bucket counts allow, and do split."""
    draw = np.random.default_rng(2)
    centres = draw.integers(0, 60, (40, jaccard_join.BUCKETS))
    counts = np.repeat(centres, 12, axis=0) + draw.integers(0, 3, (480, jaccard_join.BUCKETS))
    sizes = counts.sum(axis=1)
    counts, roots = np.column_stack([counts, np.zeros(480, int)]), np.arange(480)
    found = jaccard_join.Region(counts, sizes, roots, (9, 10), 10**9)
    calls, direct = [], found.direct
    found.direct = lambda members: (calls.append(len(members)), direct(members))
    found.join(np.arange(480))
    apart = np.abs(counts[:, None] - counts[None]).sum(axis=2)
    near = jaccard_join.may_link(apart, sizes[:, None] + sizes[None], (9, 10))
    assert {tuple(sorted(x)) for x in np.concatenate(found.pairs).tolist()} == {(i, j) for i, j in np.argwhere(near).tolist() if i < j}
    assert len(calls) > 4 and max(calls) < 240


def test_slices_are_enough_or_made_finer(spark, monkeypatch):
    """With slices so coarse that many documents have too few, they are made finer until all have enough."""
    monkeypatch.setattr(jaccard_join, "SLICE", 30.0)
    rows = near_copies(3)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted(map(tuple, jaccard_join.join(frame).collect()), key=str) == plain(rows)
