"""Periodic runs of words, found by internal pattern matching, and texts without the repeated periods.

A run is a longest stretch of words with smallest period q and at least max(`SHORTEST`, 2 q) words. Blocks of 4, 8, 16, ... words at
regular places cover each run: one of them stands in the run and again q words later, in a window whose bounds follow from its length.
The work on all texts of a batch, laid side by side with words of different texts kept apart:

1. Names of all strings of 2, 4, 8, ... words by doubling; the last names are the suffix array, and the places of a block's string are
   one interval of it.
2. A wavelet matrix over the suffix array tells how many places of that interval lie before a position and which is the next (range
   successor), so that each block's places in its window are found one after the other.
3. Places that overlap by half a block or more form a progression with the block's own period. A progression in the run of that
   period around the block itself gives no new period (two periods of one stretch would have a common divisor); it is skipped as a whole,
   others give all their distances.
4. Each distance is a candidate period; names of falling lengths tell how far it holds to both sides.

Each text is searched whole in one task, at n log n steps for n words; nothing is shuffled.

Defined results: words are runs without space or control white space. A null text has no words and no runs. A null id is an empty string in
the hash that picks the texts to be made periodic. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarnkit.llm.simhash import WORD
from tarnkit.llm.tables import extended, short_batches

SHORTEST, BASE = 12, 4
#: Words that are searched side by side.
WORDS_AT_ONCE = 1 << 18
COLUMNS = ("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


class Codes(dict):
    """Number of each different word."""

    def __missing__(self, word):
        self[word] = out = len(self)
        return out


class Names:
    """Suffix array, and names of the strings of 1, 2, 4, ... symbols at each place, until all are different.

    A name is the string's first place in the suffix array. `blocks` has, by length from `BASE` on, the slots of repeated strings in the
    suffix array as they were then: slots, first slot of the string, number of its places.
    """

    def __init__(self, symbols: np.ndarray):
        self.n = n = len(symbols)
        self.order = np.argsort(symbols, kind="stable")
        slots, values, length = np.arange(n), symbols[self.order], 1
        name = np.full(n + 1, -1, np.int32)
        self.names, self.blocks, self.base_slots = [], {}, np.zeros(0, np.int64)
        while True:
            new = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(new, len(values)))
            first = np.repeat(slots[new], sizes)
            name = name.copy()
            name[self.order[slots]] = first
            self.names.append(name)
            several = np.repeat(sizes > 1, sizes)
            slots, first, sizes = slots[several], first[several], np.repeat(sizes, sizes)[several]
            if length == BASE:
                self.base_slots = slots
            if length >= BASE and len(slots):
                places = self.order[slots]
                stride = length if length > BASE else length // 2
                here = places % stride == 0
                self.blocks[length] = places[here], first[here], sizes[here]
            if not len(slots):
                return
            places = self.order[slots]
            values = first * np.int64(n + 1) + name[np.minimum(places + length, n)] + 1
            turn = np.argsort(values, kind="stable")
            self.order[slots], values, length = places[turn], values[turn], 2 * length

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from places i < j on are equal."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name = self.names[k]
            out += (name[np.minimum(i + out, self.n)] == name[np.minimum(j + out, self.n)]).astype(np.int64) * (j + out < self.n) << k
        return out

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols before places i < j are equal."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name, a, b = self.names[k], i - out - (1 << k), j - out - (1 << k)
            out += ((a >= 0) & (name[np.maximum(a, 0)] == name[np.maximum(b, 0)])).astype(np.int64) << k
        return out


class WaveletMatrix:
    """Numbers of values below a bound, and values by rank, within intervals of an array."""

    def __init__(self, values: np.ndarray):
        self.levels = []
        for bit in range(max(1, int(values.max(initial=0)).bit_length()) - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            self.levels.append((bit, np.append(0, np.cumsum(ones)), len(values) - int(ones.sum())))
            values = np.concatenate([values[~ones], values[ones]])

    def below(self, left: np.ndarray, right: np.ndarray, bound: np.ndarray) -> np.ndarray:
        top = self.levels[0][0] + 1
        out = np.where(bound >> top > 0, right - left, 0)
        for bit, ones, zeros in self.levels:
            a, b, high = ones[left], ones[right], (bound >> bit & 1).astype(bool)
            out += np.where(high & (bound >> top == 0), right - left - (b - a), 0)
            left, right = np.where(high, zeros + a, left - a), np.where(high, zeros + b, right - b)
        return out

    def ranked(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.zeros(len(left), np.int64)
        for bit, ones, zeros in self.levels:
            a, b = ones[left], ones[right]
            low = right - left - (b - a)
            high = rank >= low
            out |= high.astype(np.int64) << bit
            rank = np.where(high, rank - low, rank)
            left, right = np.where(high, zeros + a, left - a), np.where(high, zeros + b, right - b)
        return out


def spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of `counts` numbers from each start: which start, and the number."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, starts[of] + np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def candidates(names: Names) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i and i + d of equal blocks that suggest the period d, block length by block length."""
    if not names.blocks:
        return
    slots = names.base_slots
    matrix, at = WaveletMatrix(names.order[slots]), np.searchsorted(slots, np.arange(names.n + 1))
    for length, (place, first, size) in names.blocks.items():
        left, right = at[first], at[first] + size
        low, high = (1, 4 * length - 2) if length == BASE else (2 * length - 1, 4 * length - 2)
        rank, until = matrix.below(left, right, place + low), matrix.below(left, right, place + high + 1)
        if length == BASE:
            of, ranks = spread(rank, until - rank)
            yield place[of], matrix.ranked(left[of], right[of], ranks)
            continue
        while len(live := np.flatnonzero(rank < until)):
            place, left, right, rank, until = (x[live] for x in (place, left, right, rank, until))
            found = matrix.ranked(left, right, rank)
            after = np.where(rank + 1 < until, matrix.ranked(left, right, np.minimum(rank + 1, until - 1)), found)
            step = after - found
            dense = (step > 0) & (2 * step <= length)
            many, own = np.ones(len(place), np.int64), np.zeros(len(place), bool)
            i, j = found[dense], after[dense]
            begin, end = i - names.behind(i, j), j + names.ahead(i, j)
            many[dense] = np.minimum((end - length - i) // step[dense] + 1, until[dense] - rank[dense])
            own[dense] = begin <= place[dense]
            of, number = spread(np.zeros(len(place), np.int64), np.where(own, 0, many))
            yield place[of], found[of] + number * step[of]
            rank = rank + many


def periodic_runs(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of every run, by start, then period."""
    names, found = Names(symbols), [np.zeros((0, 3), np.int64)]
    for i, j in candidates(names):
        begin, end = i - names.behind(i, j), j + names.ahead(i, j)
        good = end - begin >= np.maximum(SHORTEST, 2 * (j - i))
        rows = np.stack([begin[good], end[good], (j - i)[good]], axis=1)
        found.append(np.unique(rows, axis=0) if len(rows) else rows)
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))] if len(rows) else rows
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return rows[:, 0], rows[:, 1], rows[:, 2]


def made_periodic(words: list, key: str) -> list:
    """The words, for a tenth of the ids with a tail that repeats one period."""
    number, n = crc32(key.encode()), len(words)
    if number % 10 or not n:
        return words
    a = number // 10 % n
    p = 1 + (n - a) // (3 + number // 10 % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def described(texts: list[list[bytes]]) -> Iterator[tuple]:
    """The columns `COLUMNS` of texts given as lists of words."""
    codes = Codes()
    coded = [np.fromiter(map(codes.__getitem__, x), np.int64, len(x)) for x in texts]
    ends = np.cumsum([len(x) for x in texts], dtype=np.int64)
    symbols = np.concatenate([np.zeros(0, np.int64), *(x + k * len(codes) for k, x in enumerate(coded))])
    starts, stops, periods = periodic_runs(symbols)
    bounds = np.searchsorted(starts, np.append(0, ends))
    dropped = np.cumsum(np.bincount(starts + periods, minlength=len(symbols) + 1) - np.bincount(stops, minlength=len(symbols) + 1)) > 0
    for k, words in enumerate(texts):
        a, b, first = bounds[k], bounds[k + 1], int(ends[k]) - len(words)
        if a == b:
            yield 0, None, None, None, None, sha256(b"").hexdigest(), sha256(b" ".join(words)).hexdigest()
            continue
        start, length, period = starts[a:b] - first, (stops - starts)[a:b], periods[a:b]
        listed = "".join(f"{x},{y},{z}\n" for x, y, z in zip(start.tolist(), length.tolist(), period.tolist()))
        best = np.lexsort((period, start, -length))[0]
        kept = [w for w, gone in zip(words, dropped[first:ends[k]].tolist()) if not gone]
        yield (int(b - a), int(start[best]), int(length[best]), int(period[best]), int(1000 * length[best] // period[best]),
               sha256(listed.encode()).hexdigest(), sha256(b" ".join(kept)).hexdigest())


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", periodic_tails: bool = False) -> DataFrame:
    """Rows (key, n_runs, the longest run's start, length, period and exponent, digests of all runs and of the text without repeated periods).

    With `periodic_tails`, texts are changed first as `made_periodic` says.
    """
    short_batches(docs.sparkSession)
    schema = extended(docs, [key], COLUMNS)
    types = [pa.int64()] * 5 + [pa.string()] * 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, begin = [], 0, 0
            for k in range(batch.num_rows):
                words = WORD.findall((batch.column(1)[k].as_py() or "").encode())
                if periodic_tails:
                    own = batch.column(0)[k].as_py()
                    words = made_periodic(words, "" if own is None else str(own))
                held.append(words)
                size += len(words)
                if size >= WORDS_AT_ONCE or k == batch.num_rows - 1:
                    columns = zip(*described(held))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(begin, len(held)), *[pa.array(x, t) for x, t in zip(columns, types)]], names=schema.names)
                    held, size, begin = [], 0, k + 1

    return docs.select(key, text).mapInArrow(work, schema)
