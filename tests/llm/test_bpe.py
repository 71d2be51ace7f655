"""Encoding against the tokenizers library, decoding by round trip."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tarnkit.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


def ids_of(vocabulary, text):
    return np.frombuffer(vocabulary.encode(text), "<i4").tolist()


def test_random_texts_encode_like_the_library(library):
    vocabulary, draw = bpe.Vocabulary(bpe.read_source(PATH)), random.Random(7)
    parts = [*"aabcdef  \n\t'stlEéß中٣²😀 　\x85\x1c.,!-_0", "'ll", " the", "<|endoftext|>", "  ", "\r\n", "tion", "0000"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 40)))
        found = library.encode(text, add_special_tokens=False).ids
        assert ids_of(vocabulary, text) == found
        assert vocabulary.decode(np.array(found, np.int64)).decode() == text


@pytest.mark.parametrize("text", ["a" * 4000, "ab" * 2000, "é" * 999, "-" * 500 + "=" * 300, " " * 700 + "x", "aaa aaaaaaa aaaa"])
def test_long_runs(library, text):
    assert ids_of(bpe.Vocabulary(bpe.read_source(PATH)), text) == library.encode(text, add_special_tokens=False).ids


def test_a_small_memory_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_ENTRIES", 3)
    vocabulary = bpe.Vocabulary(bpe.read_source(PATH))
    text = "some words repeat, some words do not; some words come back " * 3
    assert ids_of(vocabulary, text) == library.encode(text, add_special_tokens=False).ids


def test_documents(library, documents):
    ids = bpe.encode(documents, PATH, keep=("doc_id", "text"))
    for row in bpe.decode(ids, PATH, keep=("doc_id", "text", "ids")).collect():
        assert row["ids"] == library.encode(row["text"] or "", add_special_tokens=False).ids
        assert bytes(row["decoded"]).decode() == (row["text"] or "")


def test_no_documents(no_documents):
    assert bpe.decode(bpe.encode(no_documents, PATH), PATH).columns == ["doc_id", "decoded"]
    assert bpe.encode(no_documents, PATH).count() == 0
