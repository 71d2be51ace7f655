"""Packing: whole documents, no gaps, full pieces, few sequences."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tarnkit.llm import packing, ranks
from tarnkit.llm.bpe import read_source

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, ids_by_doc, size):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found in by_sequence.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence)


def test_documents(documents):
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    texts = [(r["doc_id"], r["text"] or "") for r in documents.select("doc_id", "text").collect()]
    rows = packing.pack_documents(documents, PATH).collect()
    check(rows, None, 2048)
    crcs = []
    for key, text in texts:
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [0], "<u4")
        first = (len(ids) - 1) % 2048 + 1
        bounds = [0, *range(first, len(ids) + 1, 2048)]
        crcs += [(key, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    found = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(found, key=str) == sorted(crcs, key=str)


def test_texts_encode_as_the_library_does():
    library, own = Tokenizer.from_file(PATH), ranks.encoding(read_source(PATH), special=True)
    library.no_truncation()
    draw = random.Random(3)
    texts = ["".join(draw.choice(["a", "b", " ", "  ", "\n", "\t", "é", "日", "\u3000", "\xa0", "\0", "'ll", ".", "<|endoftext|>", "<|", "12"])
                     for _ in range(draw.randint(0, 30))) for _ in range(3000)]
    for text in [*texts, "x" * 5000, "<|endoftext|>" * 3]:
        assert own.encode(text, allowed_special="all", disallowed_special=()) == library.encode(text, add_special_tokens=False).ids, repr(text)


def plain_place(lengths, size):
    """For each length in falling order every choice is tried; the sum of squares over all gaps of open sequences decides."""
    gaps, out = [], {}
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        best = None
        for gap in sorted({g for g in gaps if g >= lengths[k]}):
            after = list(gaps)
            after[after.index(gap)] -= lengths[k]
            total = sum(n * n for g, n in Counter(after).items() if g)
            best = min(best or (total, gap), (total, gap))
        if best is None:
            gaps.append(size - lengths[k])
            out[k] = 0
        else:
            gaps[gaps.index(best[1])] -= lengths[k]
            out[k] = size - best[1]
    return len(gaps), sorted(gaps), [out[k] for k in range(len(lengths))]


def test_the_gap_with_the_smallest_sum_of_squares_is_taken():
    draw = np.random.default_rng(8)
    for _ in range(60):
        size = int(draw.integers(5, 30))
        lengths = draw.integers(1, size + 1, int(draw.integers(0, 40)))
        sequence, offset = packing.place(lengths, size)
        count, gaps, offsets = plain_place(lengths.tolist(), size)
        filled = np.bincount(sequence, lengths, minlength=count).astype(int)
        assert len(filled) == count and sorted((size - filled).tolist()) == gaps and offset.tolist() == offsets


def test_several_groups_and_few_sequences(spark):
    draw = np.random.default_rng(3)
    lengths = draw.integers(1, 400, 3000)
    pieces = spark.createDataFrame([(k, 0, 0, int(n), k) for k, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(pieces, 512, group_pieces=500).collect()
    assert len(rows) == 3000
    assert check(rows, None, 512) <= 1.02 * -(-lengths.sum() // 512) + 6


def test_ties_and_exact_fits():
    sequence, offset = packing.place(np.array([4, 4, 4, 4, 2, 2, 8]), 8)
    assert len(set(sequence)) == 4 and offset[6] == 0
    assert packing.place(np.zeros(0, int), 8)[0].tolist() == []


def test_no_documents(no_documents):
    assert packing.pack_documents(no_documents, PATH).count() == 0
