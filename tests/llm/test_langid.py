"""Cross-parsing against a plain parse by substring search, and held-out accuracy."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnkit.llm import langid

from .conftest import prose


def plain_phrases(sample, text):
    """Phrases of a text by longest substrings of the sample, restarting every PIECE symbols."""
    count = 0
    for k in range(0, len(text), langid.PIECE):
        piece, at = text[k:k + langid.PIECE], 0
        while at < len(piece):
            n = 0
            while at + n < len(piece) and tuple(piece[at:at + n + 1]) in sample:
                n += 1
            at, count = at + max(n, 1), count + 1
    return count


def symbols(models, text):
    """Letters, and one space after each run of them."""
    coded = models.coded(text + " ")
    return [s for s, before in zip(coded, [langid.SPACE, *coded]) if s != langid.SPACE or before != langid.SPACE]


def labelled(models, text):
    coded = models.coded(text)
    return [s for s, before in zip(coded, [-1, *coded]) if s != langid.SPACE or before != langid.SPACE]


@pytest.fixture(scope="module")
def models():
    return langid.Models({"a": [prose(1, 60, "abcde")], "b": [prose(2, 80, "abxyz"), prose(3, 20, "abxyz")], "c": ["q"]})


def test_phrases_are_those_of_a_plain_parse(models):
    texts = [prose(9, 500, "abcxyz"), prose(8, 30, "abcde"), "Abc, XYZ  12 q!", "no letters known? ñ", "a", "12", "", prose(4, 300, "qé")]
    counts, sizes = langid.phrases(models, models.alphabet(), texts)
    samples = [[prose(1, 60, "abcde")], [prose(2, 80, "abxyz"), prose(3, 20, "abxyz")], ["q"]]
    for row, parts in enumerate(samples):
        whole = [s for x in parts for s in labelled(models, x)]
        known = {tuple(whole[i:j]) for i in range(len(whole)) for j in range(i + 1, min(len(whole), i + 40) + 1)}
        for k, text in enumerate(texts):
            found = symbols(models, text)
            assert counts[row, k] == plain_phrases(known, found), (row, text[:20])
            assert sizes[k] == (len(found) if any(c.isalpha() for c in text) else 0)


def test_letters_beyond_the_table_are_not_merged(models, monkeypatch):
    """Over a thousand letters a language, and a table with few columns against one with columns for all."""
    draw = np.random.default_rng(3)
    scripts = {name: [chr(0x4E00 + int(k)) for k in draw.permutation(3000)[:1500]] for name in ("x", "y")}
    text = {name: ["".join(draw.choice(s, 900)) for _ in range(4)] for name, s in scripts.items()}
    many = langid.Models(text)
    letters = {c for texts in text.values() for x in texts for c in x}
    assert len(letters) > 1000 and len({many.symbol[c] for c in letters}) == len(letters)
    parts = [text["x"][0][40:400], text["y"][1][10:800], "\uac00" * 50, "abc"]
    counts, sizes = langid.phrases(many, many.alphabet(), parts)
    assert counts[0, 0] <= 3 and counts[1, 0] > 90 and counts[1, 1] <= 4 and counts[0, 1] > 200
    assert (counts[:, 2] >= 50).all() and (counts[:, 3] >= 3).all()
    mixed = [prose(9, 500, "abcxyzq"), prose(8, 30, "abcde"), "ab qé é", prose(5, 300, "qxé")]
    samples = {"a": [prose(1, 60, "abcde")], "b": [prose(2, 80, "abxyz"), prose(3, 20, "abxyz")], "c": ["q"]}
    whole = langid.phrases(models, models.alphabet(), mixed)[0]
    monkeypatch.setattr(langid, "DENSE", 2)
    few = langid.Models(samples)
    assert few.width < few.symbols and np.array_equal(langid.phrases(few, few.alphabet(), mixed)[0], whole)


def test_many_short_texts_parse_as_alone(models):
    texts = [prose(k, 1 + k % 7, "abcxyzé") for k in range(300)]
    counts, sizes = langid.phrases(models, models.alphabet(), texts)
    for k in (0, 17, 299):
        one, size = langid.phrases(models, models.alphabet(), [texts[k]])
        assert np.array_equal(one[:, 0], counts[:, k]) and size[0] == sizes[k]


def test_held_out_accuracy(spark):
    rows = [(k, prose(k, 40, "etaoin" if k % 2 else "äoupzk"), "x" if k % 2 else "y") for k in range(200)]
    found = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), folds=5).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r["held_out"]]
    assert len(held) > 20 and all(r["lang_pred"] == ("x" if r["doc_id"] % 2 else "y") for r in held)


def test_documents(documents):
    found = langid.identify(documents).collect()
    assert len(found) == documents.count()
    for r in found:
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (5, 6, 7, 13) or r["doc_id"] is None and r["rate"] == 0)
    kept = langid.keep_known(documents)
    assert kept.columns == documents.columns
    assert {5, 6, 7, 13}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_an_unlearned_language_of_a_learned_script_goes(spark):
    draw = random.Random(2)
    words = {x: ["".join(draw.choice("etaoinshrl") for _ in range(draw.randint(3, 9))) for _ in range(300)] for x in ("en", "de", "fi")}

    def text(name, n):
        return " ".join(draw.choice(words[name]) for _ in range(n))

    rows = [(k, text(x := ("en", "de")[k % 2], draw.choice([3, 30, 150, 600])), x) for k in range(400)]
    rows += [(1000 + k, text("fi", draw.choice([100, 150, 600])), None) for k in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in langid.keep_known(frame).collect()}
    assert len(kept & set(range(400))) >= 398 and not kept & set(range(1000, 1030))


def test_no_language_is_lost_by_null_or_equal_ids(spark):
    rows = [(None if k % 2 else 7, prose(k, 40, letters), name) for name, letters in (("x", "etaoin"), ("y", "äoupzk"), ("z", "bcdfgq")) for k in range(30)]
    models = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert models.names == ["x", "y", "z"] and min(models.weights) > 10


def test_many_languages_fit_into_the_table():
    """Entries beyond 32 bits: the table turns to wider numbers and parses alike."""
    samples = {f"l{k:03}": [prose(k, 300 // 6, "abcdefgh")] for k in range(120)}
    narrow = langid.Models(samples)
    texts = [samples["l007"][0], prose(500, 60, "abcdefgh")]
    counts = langid.phrases(narrow, narrow.alphabet(), texts)[0]
    assert narrow.kind == np.int32 and counts[7, 0] == counts.min() <= 2 < np.sort(counts[:, 0])[1]
    wide = langid.Models(samples)
    wide.table, wide.kind = wide.table.astype(np.int64), np.int64
    assert np.array_equal(langid.phrases(wide, wide.alphabet(), texts)[0], counts)


def test_batches_are_cut_by_letters(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(langid, "LETTERS", 10)
    monkeypatch.setattr(langid, "ROWS", 3)
    texts = ["abc", None, "x" * 40, "a", "b", "c", "d", "12345678", "123"]
    parts = list(langid.slices(pa.RecordBatch.from_pydict({"k": list(range(9)), "t": texts})))
    assert [x for _, part in parts for x in part] == [x or "" for x in texts]
    assert [p.column(0).to_pylist() for p, _ in parts] == [[0, 1], [2], [3, 4, 5], [6, 7], [8]]


def test_labelled_documents_of_their_language_stay(spark):
    rows = [(k, prose(k, 60, "etaoin"), "x") for k in range(100)] + [(k, prose(k, 60, "äoupzk"), "y") for k in range(100, 200)]
    odd = [(900, " ".join(prose(k, 5, "etaoinzkq") for k in range(20)), "x"), (901, prose(3, 100, "qwvjbc"), None)]
    frame = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in langid.keep_known(frame).collect()}
    assert kept >= set(range(200)) | {900} and 901 not in kept


def test_nothing_learned(documents, no_documents):
    unlabelled = documents.withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(unlabelled).collect()} == {("und", 0.0)}
    assert {r["doc_id"] for r in langid.keep_known(unlabelled).collect()} & {1, 5, 13} == {1}
    assert langid.identify(no_documents).count() == 0
    assert langid.keep_known(no_documents).count() == 0
