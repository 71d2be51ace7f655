"""SimHash fingerprints, links at a few differing bits by deletion-variant signatures, and the groups they form.

A fingerprint of 64 bits is cut into so few segments that of two fingerprints at `bits` differing bits one segment pair differs in
one bit at most: two segments for three bits. Each segment is indexed under its one-wildcard variants (one bit left out), so
such a pair shares an entry, and equal entries are joined and verified. Within an entry the fingerprints that are joined
already need no further link, so an entry of n fingerprints gives n - 1 links at most, not all pairs. An entry of more than
`BLOCK` fingerprints is cut again by the other bits, in one more part than bits may differ, one of which must agree.

Defined results: letters A-Z are lower-cased; words are runs without space or control white space. A null text is an empty one. A
text of fewer words than a shingle counts as one shingle of all its words; one without words has fingerprint zero and is linked
like any other. Each row is a document of its own, repeated rows too. A row without an id gets a fingerprint and joins a
group, but is never its smallest id: a group of such rows alone has a null component. Other columns of the input are ignored.

`keep_one` keeps one document of each group. Texts without words have one fingerprint and are copies of each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnkit.llm.components import components
from tarnkit.llm.tables import cut, extended, small_side, unused

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BLOCK = 2048


def shingle_hashes(text: str | None, width: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    words = WORD.findall((text or "").encode().translate(LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1:].tolist())), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[k:k + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """Rows (key, print): the fingerprint of each whole text as a signed 64-bit number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(shingle_hashes(x.as_py(), width, seed)) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[key, "print"])

    return docs.select(key, text).mapInArrow(work, extended(docs, [key], "print long"))


def linked_pairs(values: np.ndarray, bits: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, breadth first: fewer pairs than fingerprints."""
    rest = values
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            near = np.bitwise_count(rest ^ one) <= bits
            if near.any():
                found = rest[near]
                rest = rest[~near]
                queue.extend(found)
                yield from ((int(one), int(x)) for x in found)


def entry_pairs(values: np.ndarray, bits: int, width: int, low: int) -> Iterator[tuple[int, int]]:
    """Links among the distinct fingerprints of one index entry, which agree in the segment of `width` bits from `low` on."""
    if len(values) <= BLOCK:
        yield from linked_pairs(values, bits)
        return
    top = (low + width) % 64
    turned = (values >> np.uint64(top)) | (values << np.uint64((64 - top) % 64)) if top else values
    for part in np.array_split(np.arange(64 - width), bits + 1):
        own = (turned >> np.uint64(part[0])) & np.uint64((1 << len(part)) - 1)
        order = np.argsort(own, kind="stable")
        for run in np.split(values[order], np.flatnonzero(np.diff(own[order])) + 1):
            yield from linked_pairs(run, bits)


def segment_bounds(bits: int) -> list[tuple[int, int]]:
    """First bit and width of each segment: as few as leave one with at most one of `bits` differing bits."""
    count = max(1, (bits + 2) // 2)
    return [(int(x[0]), len(x)) for x in np.array_split(np.arange(64), count)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(prints: DataFrame, bits: int = 3) -> DataFrame:
    """Rows (a, b): links between distinct fingerprints (column `print`) that join all that differ in `bits` bits or fewer."""
    bounds = segment_bounds(bits)
    entries, of_bit = [], {}
    for low, width in bounds:
        for bit in range(low, low + width):
            of_bit[bit] = (width, low)
            mask = (((1 << width) - 1) << low) & ~(1 << bit)
            entries.append(F.struct(F.lit(bit).cast("byte").alias("bit"), F.col("print").bitwiseAND(F.lit(signed(mask))).alias("rest")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches_of(batches), [None]):
            if batch is None:
                now = held
            else:
                now = batch if held is None else [np.concatenate(x) for x in zip(held, batch)]
                last = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
                held, now = [x[last] for x in now], [x[~last] for x in now]
            if now is None or not len(now[0]):
                continue
            bit, rest, value = now
            starts = np.flatnonzero(np.concatenate([[True], (np.diff(bit) != 0) | (np.diff(rest) != 0)]))
            sizes = np.diff(np.append(starts, len(bit)))
            twos = starts[sizes == 2]
            twos = twos[np.bitwise_count(value[twos] ^ value[twos + 1]) <= bits]
            pairs = [np.stack([value[twos], value[twos + 1]], axis=1)]
            for k, n in zip(starts[sizes > 2], sizes[sizes > 2]):
                found = list(entry_pairs(value[k:k + n], bits, *of_bit[int(bit[k])]))
                if found:
                    pairs.append(np.array(found, np.uint64))
            out = np.concatenate(pairs).astype(np.uint64).view(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    def batches_of(batches):
        for x in batches:
            if x.num_rows:
                yield [x.column(0).to_numpy(), x.column(1).to_numpy(), x.column(2).to_numpy().view(np.uint64)]

    index = prints.select("print", F.explode(F.array(*entries)).alias("entry")).select("entry.bit", "entry.rest", "print")
    dealt = index.repartition("bit", "rest").sortWithinPartitions("bit", "rest")
    return dealt.mapInArrow(work, "a long, b long").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, bits: int = 3) -> DataFrame:
    """Rows (key, print, component_id): each row's fingerprint and the smallest key that links reach from it."""
    prints = cut(fingerprints(docs, key, text, width))
    distinct = prints.groupBy("print").agg(F.min(key).alias("first"))
    found = components(links(distinct.select("print"), bits))
    rooted = distinct.join(found, distinct["print"] == found["node"], "left").select(
        "print", "first", F.coalesce("root", "print").alias("root"))
    rooted = cut(rooted)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("print", "component_id")
    return prints.join(named, "print").select(key, "print", "component_id")


def lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, bits: int = 3) -> DataFrame:
    """`docs` with one row of each of the `groups`: that with the smallest key (null keys last); of rows equal in key and text any one of them.

    Rows are told apart by their key and 128 bits of a hash of key and text; only these leave the texts.
    """
    row, again = unused(docs, "row", "again")
    marked = docs.withColumns({row: F.xxhash64(key, text), again: F.xxhash64(F.lit(1), F.col(key), F.col(text))})
    place = F.struct(F.col(key).isNull().alias("unnamed"), F.col(key).alias("key"), F.col(row).alias("row"), F.col(again).alias("again"))
    found = groups(marked.select(place.alias("place"), F.col(text).alias("text")), "place", "text", width, bits)
    placed = cut(found.groupBy("place").agg(F.first("component_id").alias("component_id"), F.count("*").alias("rows")))
    names = [F.col("place.row").alias(row), F.col("place.again").alias(again)]
    twice = placed.where("place = component_id and rows > 1").select(*names)
    others = placed.where("place <> component_id or rows > 1").select(*names)
    single = marked.join(small_side(others, others.count()), [row, again], "left_anti")
    repeated = marked.join(small_side(twice, twice.count()), [row, again], "left_semi").dropDuplicates([row, again])
    return single.unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])


def hex_print(column: str = "print"):
    return F.lpad(F.lower(F.hex(column)), 16, "0")
