"""Alignment of two tokenizers' tokens by diagonal run skipping, and counts of the pairs of ids that it links.

A text, with a space put before it, is encoded by a byte-level BPE (A) and by a sentence-piece model (B, which adds that space itself).
Offsets in bytes where a token of A and one of B both end cut the tokens into groups. Both lists of end offsets are walked at the
current shift between their indices: stretches of ever doubled length whose ends agree at that shift are jumped in one comparison of
bytes, and are groups of one token each. Where ends differ, the token that ends first moves on until ends meet again: one
irregular group, which sets the shift of the next stretch. Every two tokens whose bytes overlap are linked.

Links are counted by documents in three steps: each task counts within parts of `PART` letters of text, the parts' counts are summed over the
corpus, and each part asks for the sums of its own pairs. Texts are encoded once; their pairs are stored in between. Sums are broadcast
only if they are counted to be few.

A is run by ranks (`ranks`). Words between spaces are remembered with their ids in B: no piece crosses a cut at a space that follows something else than white
space, since none has a space after another character. A text with the sign that stands for a space in pieces is encoded whole.

Defined results: a text that is null or empty, or that one of the vocabularies does not give back byte by byte, has no tokens: all numbers are
zero and the digest is empty. Strings of special tokens inside a text are text like any other. Repeated rows are documents of their own.
Other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnkit.llm.bpe import CUT, DOUBLE_SPACE, MEMORY_LETTERS, read_source
from tarnkit.llm.ranks import byte_tokens, encoding
from tarnkit.llm.runs import spread
from tarnkit.llm.tables import cut, extended, short_batches, small_side

#: Letters of text whose pairs are counted and answered together; entries of remembered words.
PART, ENTRIES = 8 << 20, 400_000
#: Fixed value: the sign that the pieces have for a space.
PIECE_SPACE = "▁"


class Tokenizers:
    """Both vocabularies: ids of texts, and bytes and decimal strings of ids."""

    def __init__(self, source: str, model: bytes):
        self.a_bytes, self.b = byte_tokens(source), sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a = encoding(source, special=False)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(k) else x.replace(PIECE_SPACE, " ").encode() for k, x in enumerate(pieces)]
        self.lengths = [np.array([len(x) for x in xs], np.int32) for xs in (self.a_bytes, self.b_bytes)]
        #: Ids of A and of B as text, each inside its group (even places) and at its group's end (odd places).
        self.second = 2 * len(self.a_bytes)
        self.decimals = [f"{k}{sign}" for size, end in zip(map(len, self.lengths), "|;") for k in range(size) for sign in ("," + end)]
        self.b_data = np.frombuffer(b"".join(self.b_bytes), np.uint8)
        self.b_starts = np.cumsum(self.lengths[1]) - self.lengths[1]
        self.recent, self.older = {}, {}
        self.space = array("i", [self.b.piece_to_id(PIECE_SPACE)]).tobytes()

    def pieces(self, words: list[str]) -> bytes:
        """Ids in B of words with a space before each, as 32-bit numbers; the last `ENTRIES` words at least are remembered."""
        found = list(map(self.recent.get, words))
        if None in found:
            places = [k for k, x in enumerate(found) if x is None]
            known = {words[k]: self.older.get(words[k]) for k in places}
            new = [x for x, y in known.items() if y is None and x]
            known |= {x: array("i", y).tobytes() for x, y in zip(new, self.b.encode(new, num_threads=1))} | {"": self.space}
            for k in places:
                found[k] = known[words[k]]
            self.recent.update((x, y) for x, y in known.items() if len(x) <= MEMORY_LETTERS)
            if len(self.recent) >= ENTRIES:
                self.recent, self.older = {}, self.recent
        return b"".join(found)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of a space and the text in both vocabularies and where their tokens end; none where a vocabulary does not give back its bytes."""
        if not text:
            return None
        whole = " " + text
        if PIECE_SPACE in text:
            b = np.array(self.b.encode(text), np.int32)
        else:
            b = np.frombuffer(self.pieces((CUT.split(whole) if DOUBLE_SPACE.search(whole) else whole.split(" "))[1:]), np.int32)
        a, data = np.array(self.a.encode_ordinary(whole), np.int32), np.frombuffer(whole.encode(), np.uint8)
        a_ends, b_ends = (np.cumsum(x[y], dtype=np.int32) for x, y in zip(self.lengths, (a, b)))
        if a_ends[-1] != len(data) or b_ends[-1] != len(data):
            return None
        lengths = self.lengths[1][b]
        same = np.array_equal(data, self.b_data[np.repeat(self.b_starts[b] - b_ends + lengths, lengths) + np.arange(len(data))])
        return (a, b, a_ends, b_ends) if same else None

    def listing(self, a: np.ndarray, b: np.ndarray, a_bounds: np.ndarray, b_bounds: np.ndarray) -> str:
        """Groups of ids as `a1,a2|b1;a3|b2,b3`, from the index after each group's last token."""
        own = []
        for ids, bounds, base in ((a, a_bounds, 0), (b, b_bounds, self.second)):
            last = np.zeros(len(ids), np.int64)
            last[bounds - 1] = 1
            own.append((base + 2 * ids.astype(np.int64) + last, np.cumsum(last) - last))
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.append(0, b_bounds)[own[0][1]]] = own[0][0]
        order[np.arange(len(b)) + a_bounds[own[1][1]]] = own[1][0]
        return "".join(map(self.decimals.__getitem__, order.tolist()))[:-1]


def align(a_ends: np.ndarray, b_ends: np.ndarray, probe: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each group the index after its last token in A and in B; for each link inside irregular groups its index in A and in B.

    Both lists of ends (32-bit numbers) rise and have the same last one. At a shift, `probe` ends and then ever twice as many are
    compared as one number; the lowest bit in which two such numbers differ shows where the stretch ends.
    """
    left, right, a, b, n = a_ends.tobytes(), b_ends.tobytes(), a_ends.tolist(), b_ends.tolist(), len(a_ends)
    number, found, linked_a, linked_b = int.from_bytes, array("i"), array("i"), array("i")
    add, add_a, add_b = found.extend, linked_a.append, linked_b.append
    i = j = 0
    while i < n:
        begin, step, shift = i, 4 * probe, 4 * (j - i)
        at = 4 * i
        while not (apart := number(left[at:at + step], "little") ^ number(right[at + shift:at + shift + step], "little")) and at < len(left):
            at += step
            step *= 2
        i = min(n, (at >> 2) + (((apart & -apart).bit_length() - 1) >> 5)) if apart else n
        if i > begin:
            add((begin + 1, j + 1, i - begin))
            j += i - begin
            if i == n:
                break
        x, y = a[i], b[j]
        add_a(i)
        add_b(j)
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
            add_a(i)
            add_b(j)
        i, j = i + 1, j + 1
        add((i, j, 1))
    rows = np.frombuffer(found, np.int32).reshape(-1, 3).astype(np.int64)
    of, a_bounds = spread(rows[:, 0], rows[:, 2])
    return a_bounds, a_bounds + (rows[:, 1] - rows[:, 0])[of], np.frombuffer(linked_a, np.int32), np.frombuffer(linked_b, np.int32)


def encoded(batches: Iterator[pa.RecordBatch], tokenizers: Tokenizers, names: list[str], kind: str) -> Iterator[pa.RecordBatch]:
    """A row for each text: its key, numbers of tokens, groups and links, digest, part, pairs of ids and how often each is linked."""
    part, letters, product = TaskContext.get().partitionId() << 32, 0, len(tokenizers.b_bytes)
    types = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.binary(), pa.binary()]
    for batch in batches:
        rows: list[tuple] = []
        for text in batch.column(1):
            text = text.as_py()
            letters += len(text or "")
            found = tokenizers.encode(text)
            if found is None:
                rows.append((0, 0, 0, 0, "", part, b"", b""))
            else:
                a, b, a_ends, b_ends = found
                a_bounds, b_bounds, i, j = align(a_ends, b_ends)
                single = (np.diff(a_bounds, prepend=0) == 1) & (np.diff(b_bounds, prepend=0) == 1)
                i, j = np.append(i, a_bounds[single] - 1), np.append(j, b_bounds[single] - 1)
                pairs, times = np.unique(a[i].astype(np.int64) * product + b[j], return_counts=True)
                times = times.astype(np.min_scalar_type(int(times.max()))).tobytes()
                listed = sha256(tokenizers.listing(a, b, a_bounds, b_bounds).encode()).hexdigest()
                rows.append((len(a), len(b), len(a_bounds), len(i), listed, part, pairs.astype(kind).tobytes(), times))
            if letters >= PART:
                part, letters = part + 1, 0
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, t) for x, t in zip(zip(*rows), types)]], names=names)


def stored_pairs(table: pa.Table | pa.RecordBatch, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of all rows in one array, how often each is linked, and the places where rows begin and the last one ends."""
    pairs, times = (table.column(c).to_pylist() for c in ("pairs", "times"))
    pairs = [np.frombuffer(x, kind).astype(np.int64) for x in pairs]
    times = [np.frombuffer(x, f"<u{len(x) // len(y)}").astype(np.int64) for x, y in zip(times, pairs) if len(y)]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *pairs]), np.concatenate([none, *times]), np.cumsum([0, *map(len, pairs)])


def counted(batches: Iterator[pa.RecordBatch], kind: str, at_once: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """(part, pair, docs): in how many rows of a part, which come one after the other, each pair stands."""

    def rows(part: np.ndarray, pair: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((pair, part))
        part, pair = part[order], pair[order]
        new = np.flatnonzero(np.append(True, (np.diff(part) != 0) | (np.diff(pair) != 0)))
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (part[new], pair[new], np.diff(np.append(new, len(part))))], names=["part", "pair", "docs"])

    held, size = [], 0
    for batch in batches:
        pair, _, ends = stored_pairs(batch, kind)
        held.append((np.repeat(batch.column("part").to_numpy(), np.diff(ends)), pair))
        size += len(pair)
        if size >= at_once:
            yield rows(*map(np.concatenate, zip(*held)))
            held, size = [], 0
    if size:
        yield rows(*map(np.concatenate, zip(*held)))


def aligned(docs: DataFrame, path: str, model_path: str, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """Each row's numbers and stored pairs; (part, pair) asked; (pair, a, docs, is_best) of the corpus; the kind of numbers stored.

    A pair is its id in A times the size of B plus its id in B; `is_best` says that none of its A id's pairs is in more rows.
    """
    spark = docs.sparkSession
    short_batches(spark)
    source = read_source(path)
    with open(model_path, "rb") as f:
        model = f.read()
    product = sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size()
    kind = "<u4" if len(byte_tokens(source)) * product <= 1 << 32 else "<u8"
    shared = spark.sparkContext.broadcast((source, model))
    schema = extended(docs, [key], "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, part long, pairs binary, times binary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return encoded(batches, loaded(*shared.value), schema.names, kind)

    rows = cut(docs.select(key, text).mapInArrow(work, schema))
    found = cut(rows.select("part", "pairs", "times").mapInArrow(lambda x: counted(x, kind), "part long, pair long, docs long"))
    totals = found.groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("a", F.expr(f"pair div {product}"))
    best = totals.groupBy("a").agg(F.max("docs").alias("most"))
    known = cut(totals.join(best, "a").select("pair", "a", "docs", (F.col("docs") == F.col("most")).alias("is_best")))
    return rows, found.select("part", "pair"), known, kind


def link_counts(docs: DataFrame, path: str, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of all documents."""
    rows, found, known, kind = aligned(docs, path, model_path, key, text)
    few = small_side(known.select("pair", "docs", "is_best"), known.count())
    answers = found.join(few, "pair")
    names = [key, "n_a", "n_b", "n_groups", "n_links"]
    schema = extended(rows, names, "n_best long, count_sum long, groups_sha256 string")

    def work(own: pa.Table, told: pa.Table) -> pa.Table:
        pairs, times, ends = stored_pairs(own, kind)
        pair, count, best = (told.column(c).to_numpy() for c in ("pair", "docs", "is_best"))
        order = np.argsort(pair)
        place = order[np.searchsorted(pair[order], pairs)] if len(pairs) else np.zeros(0, np.int64)
        sums = [np.append(0, np.cumsum(times * x[place])) for x in (best.astype(np.int64), count)]
        columns = [own.column(c) for c in names] + [pa.array(x[ends[1:]] - x[ends[:-1]]) for x in sums] + [own.column("groups_sha256")]
        return pa.table(columns, names=schema.names)

    return rows.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(work, schema)


LOADED: dict[int, Tokenizers] = {}


def loaded(source: str, model: bytes) -> Tokenizers:
    """The tables of both vocabularies, built once for each worker."""
    own = hash((source, model))
    if own not in LOADED:
        LOADED.clear()
        LOADED[own] = Tokenizers(source, model)
    return LOADED[own]
