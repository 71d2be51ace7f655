"""Counts against a plain version; robust estimates against numpy."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tarnkit.llm import quality

from .conftest import prose


def plain_counts(text):
    words = re.findall("[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
    repeated = {j for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for j in range(k, k + 3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    seen, again = set(), 0
    for x in lines:
        again += x in seen
        seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(repeated)


def test_documents(documents):
    rows = {str(tuple(r)): r for r in documents.select("doc_id", "text").collect()}
    wanted = sorted(((r["doc_id"], *plain_counts(r["text"])) for r in documents.select("doc_id", "text").collect()), key=str)
    found = quality.judge(documents).collect()
    assert len(rows) <= len(found)
    assert sorted(((r["doc_id"], *(r[c] for c in quality.COUNTS)) for r in found), key=str) == wanted
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_symbol_heavy_texts_go_and_others_stay(spark):
    rows = []
    for k in range(600):
        words = prose(k, 80).split(" ")
        bad = k % 20 == 0
        rows.append((k, " ".join(w + "***" if bad else w for w in words), "en", ["a", "b", "small"][0 if k < 300 else 1 if k < 590 else 2], bad))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, bad boolean")
    verdicts = {r["doc_id"]: r["kept"] for r in quality.judge(frame).collect()}
    big = [r for r in rows if r[3] != "small"]
    assert all(verdicts[r[0]] != r[4] for r in big)
    assert {r["doc_id"] for r in quality.keep_good(frame).collect()} == {k for k, kept in verdicts.items() if kept}


def test_repetition_below_the_base_limit_goes_in_a_clean_group(spark):
    rows = []
    for k in range(300):
        lines = [prose(20 * k + x, 9) for x in range(20)]
        if k < 5:  # 9 of 20 lines are repeated, in another order of words so that windows are not
            lines = [*lines[:11], *(["tis"] * 9)]
        elif k < 10:  # 45% of words stand in repeated windows, no line is repeated
            lines = [*lines[:11], *[f"{x} {prose(k, 6)} {prose(9 * k + n, 1)}" for n, x in enumerate("abcdefghi")]]
        elif k < 15:  # one repeated line alone
            lines[19] = lines[3]
        rows.append((k, "\n".join(lines), "en", "web"))
    found = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(found[k]["base_failed"] for k in range(15))
    assert not any(found[k]["kept"] for k in range(10))
    assert all(found[k]["kept"] for k in range(10, 15)) and sum(found[k]["kept"] for k in range(15, 300)) >= 283


def test_estimate_finds_the_bulk(spark, monkeypatch):
    draw = np.random.default_rng(4)
    cov = np.array([[1.0, 0.6], [0.6, 2.0]])
    bulk = draw.multivariate_normal([3, -1], cov, 4000)
    far = draw.multivariate_normal([20, 20], np.eye(2), 1000)
    rows = [("p", float(a), float(b)) for a, b in np.concatenate([bulk, far])]
    frame = spark.createDataFrame(rows, "pool string, x double, y double")
    found = quality.minimum_covariance(frame, ["x", "y"], [0.01, 0.01], 1).first()
    assert np.allclose(found["centre"], [3, -1], atol=0.15)
    near = frame.join(quality.minimum_covariance(frame, ["x", "y"], [0.01, 0.01], 1), "pool").select(
        "x", (quality.distance(["x", "y"]) / F.col("scale")).alias("d"))
    by_side = near.groupBy(F.col("x") > 12).agg(F.min("d"), F.max("d")).collect()
    assert min(r[1] for r in by_side if r[0]) > max(r[2] for r in by_side if not r[0])


def test_pools(spark):
    rows = [("en", "a")] * 150 + [("en", "b")] * 60 + [("en", None)] * 70 + [("de", "a")] * 20 + [(None, None)] * 90
    frame = spark.createDataFrame(rows, "lang string, source string")
    found, number = quality.pooled(frame)
    assert number == 5
    counts = {r["pool"]: r["count"] for r in found.groupBy("pool").count().collect()}
    assert sorted(counts.values()) == [110, 130, 150] and counts["rest"] == 110


def test_no_documents(no_documents):
    assert quality.judge(no_documents).count() == 0
    assert quality.keep_good(no_documents).columns == no_documents.columns


def test_stage_keeps_what_the_verdict_keeps_and_clashing_columns(spark, documents):
    docs = documents.withColumn("__row", F.lit(5)).withColumn("__again", F.lit("x"))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    verdicts = [r["doc_id"] for r in quality.judge(documents).where("kept").collect()]
    found = kept.collect()
    assert sorted(map(str, (r["doc_id"] for r in found))) == sorted(map(str, verdicts))
    assert all(r["__row"] == 5 and r["__again"] == "x" for r in found)
