"""Exact best rows against numpy."""

import numpy as np
import pytest

from tarnkit.llm import topk


def plain_top(ids, values, every, k):
    out = []
    for q in sorted({i for i in ids if i % every == 0}):
        query = values[ids.index(q)]
        found = sorted((-int(values[j] @ query), i) for j, i in enumerate(ids) if i != q)[:k]
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(found)]
    return out


@pytest.mark.parametrize("blocks", [(8192, 1024), (30, 2)])
def test_random_vectors_and_ties(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "ROW_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[1])
    draw = np.random.default_rng(1)
    vectors = draw.normal(0, 0.2, (300, 7)).astype(np.float32)
    vectors[40:140] = vectors[5]
    vectors[200] = 0
    rows = [(int(k), [float(x) for x in v], k) for k, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score long").repartition(3)
    values = np.floor(256 * vectors.astype(np.float64)).astype(np.int64)
    wanted = plain_top(list(range(300)), values, 50, 5)
    assert sorted(map(tuple, topk.top_k(frame).collect())) == wanted


def test_awkward_rows(spark):
    rows = [(0, [0.5, 0.25]), (1, [0.5, 0.25]), (2, None), (3, [0.5, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
            (None, [9.0, 9.0]), (6, [1.0]), (7, [-0.5, 0.1]), (0, [0.5, 0.25]), (50, []), (100, [0.1, 0.1, 0.1])]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted(map(tuple, found.collect())) == [(0, 1, 1, 128 * 128 + 64 * 64), (0, 2, 7, 128 * -128 + 64 * 25)]
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_large_and_equal_values():
    values = np.array([[1 << 20, -5], [-(1 << 20), 7], [3, 3], [3, 3]], np.int64)
    index = topk.BitSlices(values)
    for query in ([1, 1], [-1, 0], [0, 0], [12345, -999]):
        want = sorted(range(4), key=lambda k: (-int(values[k] @ np.array(query)), k))[:2]
        assert sorted(index.top(np.array(query), 2, index.all).tolist()) == sorted(want)
