"""Fingerprints and groups against a brute-force version."""

import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tarnkit.llm import simhash
from tarnkit.llm.components import components


def plain_print(text, width=3):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k:k + width]), 42) for k in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(values, bits):
    roots = list(range(len(values)))
    for i, a in enumerate(values):
        for j, b in enumerate(values[:i]):
            if (int(a) ^ int(b)).bit_count() <= bits:
                old, new = max(roots[i], roots[j]), min(roots[i], roots[j])
                roots = [new if r == old else r for r in roots]
    return roots


def clustered(draw, groups, size, most=5):
    out = []
    for center in draw.integers(0, 1 << 63, groups, dtype=np.uint64):
        for _ in range(size):
            out.append(int(center) ^ sum(1 << int(b) for b in draw.choice(64, draw.integers(0, most), replace=False)))
    return sorted(set(out))


def groups_of(spark, values, bits):
    frame = spark.createDataFrame([(simhash.signed(v),) for v in values], "print long")
    found = components(simhash.links(frame, bits)).collect()
    root = {r["node"]: r["root"] for r in found}
    sets = {}
    for v in values:
        sets.setdefault(root.get(simhash.signed(v), simhash.signed(v)), set()).add(v)
    return {frozenset(x) for x in sets.values()}


def check_groups(spark, values, bits):
    sets = {}
    for v, r in zip(values, plain_roots(values, bits)):
        sets.setdefault(r, set()).add(v)
    assert groups_of(spark, values, bits) == {frozenset(x) for x in sets.values()}


def test_links_find_all_groups(spark):
    draw = np.random.default_rng(5)
    check_groups(spark, clustered(draw, 30, 8), 3)
    check_groups(spark, clustered(draw, 20, 8, 8), 5)


def test_large_entries_are_cut_again(spark, monkeypatch):
    draw = np.random.default_rng(6)
    low = draw.integers(0, 1 << 32, 40, dtype=np.uint64)
    values = sorted({int(x) ^ (1 << int(b)) for x in low for b in draw.integers(0, 32, 6)})
    for size in (8, 2048):
        monkeypatch.setattr(simhash, "BLOCK", size)
        found = set(simhash.entry_pairs(np.array(values, np.uint64), 3, 32, 32))
        joined = set(range(len(values)))
        place = {v: k for k, v in enumerate(values)}
        roots = list(joined)
        for a, b in found:
            old, new = sorted((roots[place[a]], roots[place[b]]), reverse=True)
            roots = [new if r == old else r for r in roots]
        assert [roots.index(r) for r in roots] == [x.index(y) for x in [plain_roots(values, 3)] for y in x]


def test_documents(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    prints = [plain_print(x) for _, x in rows]
    roots = plain_roots(prints, 3)
    least = {r: min([k for (k, _), q in zip(rows, roots) if q == r and k is not None], default=None) for r in set(roots)}
    found = simhash.groups(documents).select("doc_id", simhash.hex_print().alias("print"), "component_id").collect()
    assert sorted(map(tuple, found), key=str) == sorted(((k, f"{p:016x}", least[r]) for (k, _), p, r in zip(rows, prints, roots)), key=str)


def test_keep_one(documents):
    kept = [r["doc_id"] for r in simhash.keep_one(documents).collect()]
    assert kept.count(1) == 1 and not {2, 3} & set(kept)
    assert {4, 8, 10, 12} <= set(kept)


def plain_kept(rows):
    """Of each group of linked (key, text) the row with the smallest key, null keys last; equal rows once."""
    roots = plain_roots([plain_print(x) for _, x in rows], 3)
    least = {r: min(((k is None, k or 0) for (k, _), q in zip(rows, roots) if q == r)) for r in set(roots)}
    return least, roots


def test_keep_one_against_brute_force(spark, documents):
    draw, rows = np.random.default_rng(7), [(r["doc_id"], r["text"]) for r in documents.collect()]
    for k in range(60):
        words = [f"w{x}" for x in draw.integers(0, 5000, 300)]
        for copy in range(3):
            changed = [f"new{x}" if draw.random() < 0.006 * copy else x for x in words]
            rows.append((1000 + 10 * k + (copy + k) % 3, " ".join(changed)))
    least, roots = plain_kept(rows)
    assert 20 < len(set(roots)) < len(rows) - 60
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == sorted(least.values())
    assert {(r["doc_id"], r["text"]) for r in kept} <= set(rows)


def test_keep_one_leaves_columns_with_clashing_names(spark):
    rows = [(1, "one two three four", 7, "x"), (1, "one two three four", 8, "y"), (2, "one two three four", 9, None), (3, None, 10, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row long, ___AGAIN string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    found = sorted(map(tuple, kept.collect()))
    assert len(found) == 2 and found[0] in rows[:2] and found[1] == rows[3]


def test_components_of_chains_and_loops(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 100), (200, 300), (300, 200), (7, 9)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(1, 51)} | {300: 200}


def test_no_documents(no_documents):
    assert simhash.groups(no_documents).count() == 0
    assert simhash.keep_one(no_documents).agg(F.count("*")).first()[0] == 0
