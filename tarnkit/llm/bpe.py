"""Byte-level BPE: exact merges by longest matches and backtracking, decoding through an offset table.

The vocabulary comes from a `tokenizers` JSON file of the byte-level kind and is never trained here. A word is encoded from
left to right: the Aho-Corasick automaton of all tokens gives the longest match at a position; it is taken if the pair with the
token before it is one that the merges leave standing (`Vocabulary.stands`, a table filled as pairs occur), else the next
shorter token is tried, else the last token is given back. Each position is given up at most once, so the work is linear.

Defined results: a null text encodes like an empty one, to no ids. Ids outside the vocabulary and null ids raise on decoding;
a null list of ids decodes to the empty text. Repeated rows stay. Other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnkit.llm.tables import extended, short_batches

#: The split of byte-level BPE before its merges. White space as Unicode lists it.
SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
         r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Entries and letters of words that a worker remembers; longer words are encoded anew each time.
MEMORY_ENTRIES, MEMORY_LETTERS = 200_000, 48


def byte_letters() -> dict[str, int]:
    """Letter of a byte-level vocabulary to byte: printable bytes stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Memory(dict):
    """What a function gave for short texts or pairs: those of the last `entries` at least, of twice as many at most."""

    def __init__(self, work, entries: int | None = None):
        super().__init__()
        self.work, self.older, self.entries = work, {}, entries or MEMORY_ENTRIES

    def __missing__(self, text):
        out = self.older.get(text)
        if out is None:
            out = self.work(text)
        if len(text) <= MEMORY_LETTERS:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[text] = out
        return out


class Vocabulary:
    """Tokens, merges and special tokens of one JSON file, and the tables derived from them."""

    def __init__(self, source: str):
        model = json.loads(source)
        letters = byte_letters()
        ids, merges = model["model"]["vocab"], model["model"]["merges"]
        self.special = {x["content"]: x["id"] for x in model["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, k in ids.items():
            self.tokens[k] = bytes(letters[c] for c in token)
        for token, k in self.special.items():
            self.tokens[k] = token.encode()
        self.made = [-1] * size
        self.parts = [(-1, -1)] * size
        self.rank: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(merges):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair, whole = (ids[left], ids[right]), ids[left + right]
            self.rank[pair] = rank
            self.made[whole], self.parts[whole] = rank, pair
        self.automaton = ahocorasick.Automaton()
        for k in ids.values():
            self.automaton.add_word(self.tokens[k].decode("latin-1"), k)
        self.automaton.make_automaton()
        known = {self.tokens[k]: k for k in ids.values()}
        self.shorter = [-1] * size
        for token, k in known.items():
            self.shorter[k] = next((known[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in known), -1)
        self.lengths = [len(x) for x in self.tokens]
        self.pairs = Memory(lambda pair: self.stands(*pair))
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.words = Memory(self.encode_word, 2 * MEMORY_ENTRIES)
        self.plain = Memory(self.encode_run)
        self.spaced = Memory(lambda piece: self.encode_run(" " + piece))
        self.line_end = self.encode_run("\n")
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def stands(self, a: int, b: int) -> bool:
        """Whether the merges leave tokens a, b side by side.

        Undo the merges inside both tokens, latest first, and look at the pair at the seam: where it has a merge that comes
        before either side is used up, the merges would have joined it. Among equal merges the left one comes first.
        """
        x, y, left_until, right_until = a, b, len(self.rank), len(self.rank)
        while True:
            r = self.rank.get((x, y))
            if r is not None and r < left_until and r <= right_until:
                return False
            if self.made[x] > self.made[y]:
                left_until, x = self.made[x], self.parts[x][1]
            elif self.made[y] >= 0:
                right_until, y = self.made[y], self.parts[y][0]
            else:
                return True

    def encode_word(self, word: str) -> bytes:
        """Ids of one word as little-endian 32-bit numbers."""
        data = word.encode()
        text, size = data.decode("latin-1"), len(data)
        longest, lengths, shorter, pairs = self.automaton.iter_long, self.lengths, self.shorter, self.pairs
        greedy = [k for _, k in longest(text)]
        good = list(map(pairs.__getitem__, zip(greedy, greedy[1:])))
        if all(good):
            return array("i", greedy).tobytes()
        stop = good.index(False) + 1
        tokens, token = greedy[:stop], shorter[greedy[stop]]
        at, before = sum(map(lengths.__getitem__, tokens)), tokens[-1]
        given_up: set[int] = set()
        while at < size:
            while token >= 0:
                end = at + lengths[token]
                if end not in given_up and (before < 0 or pairs[before, token]):
                    break
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                at, before, token = end, token, next(longest(text, end))[1] if end < size else -1
            else:
                given_up.add(at)
                token = tokens.pop()
                at, before = at - lengths[token], tokens[-1] if tokens else -1
        return array("i", tokens).tobytes()

    def encode_run(self, run: str) -> bytes:
        return b"".join(map(self.words.__getitem__, WORDS(run)))

    def encode_plain(self, text: str) -> bytes:
        """Ids of a text without special tokens.

        No word of the split holds white space after something else, so the text may be cut there and runs of letters between
        spaces remembered whole. A line end between two other characters is a word of its own.
        """
        if DOUBLE_SPACE.search(text):
            pieces = CUT.split(text)
            return self.plain[pieces[0]] + b"".join(map(self.spaced.__getitem__, pieces[1:]))
        plain, spaced, found = self.plain, self.spaced.__getitem__, []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            found.append(plain[first] + b"".join(map(spaced, rest)))
        return self.line_end.join(found)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.cut_special is None or not self.cut_special.search(text):
            return self.encode_plain(text)
        return b"".join(
            np.array([self.special[x]], "<i4").tobytes() if k % 2 else self.encode_plain(x) if x else b""
            for k, x in enumerate(self.cut_special.split(text)))

    def decode(self, ids: np.ndarray) -> bytes:
        starts = self.offsets[ids]
        lengths = self.offsets[ids + 1] - starts
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        return self.bytes[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1])].tobytes()


WORDS = regex.compile(SPLIT).findall
DOUBLE_SPACE, CUT = re.compile(r"\s\s"), re.compile(r"(?<!\s) ")
LOADED: dict[int, Vocabulary] = {}


def vocabulary(source: str) -> Vocabulary:
    """The tables of a JSON file's text, built once for each worker."""
    key = hash(source)
    if key not in LOADED:
        LOADED.clear()
        LOADED[key] = Vocabulary(source)
    return LOADED[key]


def read_source(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(frame: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, then `ids` (array of int) of each row's whole text, with the vocabulary in the JSON file `path`."""
    short_batches(frame.sparkSession)
    source = frame.sparkSession.sparkContext.broadcast(read_source(path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(source.value)
        for batch in batches:
            for part in slices(batch):
                found = [words.encode(x.as_py()) for x in part.column(len(keep))]
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4")))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], names=[*keep, "ids"])

    return frame.select(*keep, F.col(text).alias("__text")).mapInArrow(work, extended(frame, keep, "ids array<int>"))


def decode(frame: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, then `decoded` (binary): the bytes of each row's ids, special tokens included."""
    short_batches(frame.sparkSession)
    source = frame.sparkSession.sparkContext.broadcast(read_source(path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(source.value)
        for batch in batches:
            for part in slices(batch):
                lists = part.column(len(keep))
                out = [words.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else b"" for x in lists]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, pa.binary())], names=[*keep, "decoded"])

    return frame.select(*keep, F.col(ids).alias("__ids")).mapInArrow(work, extended(frame, keep, "decoded binary"))


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in short pieces, so that what is made from one piece stays small."""
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)
