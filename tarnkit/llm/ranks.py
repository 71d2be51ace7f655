"""Fast encoding by a byte-level BPE vocabulary whose merges follow from its ids as ranks.

`tiktoken` joins the neighbours whose joined bytes have the smallest id. A JSON file's merges give the same ids where its ids rise with its merges
and each of its tokens encodes to itself; the tests check both for the vocabulary in use.
"""

from __future__ import annotations

import json

import tiktoken

from tarnkit.llm.bpe import SPLIT, byte_letters


def byte_tokens(source: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary in a JSON file's text, without its special tokens."""
    letters, ids = byte_letters(), json.loads(source)["model"]["vocab"]
    out = [b""] * (max(ids.values()) + 1)
    for token, k in ids.items():
        out[k] = bytes(map(letters.get, token)) if all(c in letters for c in token) else b""
    return out


def special_tokens(source: str) -> dict[str, int]:
    return {x["content"]: x["id"] for x in json.loads(source)["added_tokens"]}


def encoding(source: str, special: bool) -> tiktoken.Encoding:
    """The vocabulary; with `special`, the strings of its special tokens are those tokens wherever they stand."""
    own = special_tokens(source)
    ranks = {x: k for k, x in enumerate(byte_tokens(source)) if x and k not in own.values()}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=own if special else {})


LOADED: dict[tuple[int, bool], tiktoken.Encoding] = {}


def loaded(source: str, special: bool) -> tiktoken.Encoding:
    """The vocabulary, built once for each worker."""
    own = hash(source), special
    if own not in LOADED:
        LOADED.clear()
        LOADED[own] = encoding(source, special)
    return LOADED[own]
