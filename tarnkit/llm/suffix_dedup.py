"""Removal of every byte that a repeated string of `SPAN` bytes covers, over all texts, by sorting a cover of their suffixes.

A string that stands at two places does so with the same *sampled* position inside: positions whose next bytes have a
fingerprint that is 0 modulo `RARITY`, positions counted back from these in steps of `STEP`, and, where no such
position is near, every position. Like the residues of a difference cover they meet in every pair of equal strings, but they
depend on the bytes alone, and only a few in a hundred suffixes are sampled. The work is then that of a difference-cover sort:

1. Sampled suffixes are sorted by the name (fingerprint) of the bytes that follow them, joined by doubling from names of
   shorter strings. Most names occur once; these suffixes go no further.
2. Each sampled suffix stands for the suffixes up to `STEP` - 1 bytes before it, whose strings all lie within one context. Where
   a context occurs at several places, all its strings repeat: that is settled without sorting them one by one.
3. The remaining suffixes, one for each different context among those with a common name, are sorted by all `SPAN` bytes.
4. Adjacent equal prefixes are repeats; repeated strings become spans, spans are cut from the texts.

A residue class cover would sort two thirds of all suffixes; at 16 bytes each that alone moves eleven times the text.

Arrays of fingerprints are dealt by Spark in buckets whose number follows the bytes of input. What occurs several times among
the texts of one task is settled there and sent once, so a passage that a third of all texts share is one record for each task.

Defined results: a null text is an empty one and, like every text of fewer than `SPAN` bytes, loses nothing and makes nothing repeat.
Repeated rows are different places. Rows are told apart by a 64-bit hash of key and text; rows equal in both have equal results.
Names are 64-bit fingerprints. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnkit.llm.tables import cut

SPAN, STEP, RARITY, TRIGGER = 200, 64, 32, 8
AHEAD = SPAN - STEP
#: Bytes of text that are fingerprinted at once, that one record carries the names of, and that one bucket serves.
CHUNK, FLUSH, BUCKET = 1 << 19, 8 << 20, 32 << 20
FACTOR, OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprints of strings from those of their two parts."""
    out = a ^ (a >> np.uint64(29))
    out *= FACTOR
    out ^= out >> np.uint64(32)
    out += b
    out *= OTHER
    return out


def fingerprints(data: np.ndarray) -> dict[int, np.ndarray]:
    """Length to the fingerprints of all strings of that length."""
    now, of = (data.astype(np.uint64) + np.uint64(1)) * OTHER, {}
    for n in (1, 2, 4, 8, 16, 32, 64, 128):
        if n in (TRIGGER, 64, 128):
            of[n] = now
        now = joined(now[:len(now) - n], now[n:]) if len(now) > n else now[:0]
    whole = max(0, len(data) - SPAN + 1)
    near = max(0, len(data) - AHEAD + 1)
    of[AHEAD] = joined(of[128][:near], of[8][128:128 + near])
    of[SPAN] = joined(joined(of[128][:whole], of[64][128:128 + whole]), of[8][192:192 + whole])
    return {n: of[n] for n in (TRIGGER, AHEAD, SPAN)}


def sampled(trigger: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sampled positions of texts at [start, end) of a buffer: position, first string before it and number of strings."""
    rare = np.flatnonzero(trigger % np.uint64(RARITY) == 0)
    text = np.searchsorted(starts, rare, side="right") - 1
    inside = (text >= 0) & (rare + TRIGGER <= ends[text])
    rare, text = rare[inside], text[inside]
    order = np.argsort(np.concatenate([text, np.arange(len(starts))]), kind="stable")
    at = np.concatenate([rare, ends + SPAN])[order]
    text = np.concatenate([text, np.arange(len(starts))])[order]
    before = np.concatenate([[-1], at[:-1]])
    before = np.where(np.concatenate([[-1], text[:-1]]) == text, before, starts[text] - 1)
    last = ends[text] - SPAN
    far = SPAN - TRIGGER
    found = []
    for back in range(0, far + 1, STEP):
        here = at - back
        first = np.maximum(np.maximum(before + 1, here - STEP + 1), at - far)
        final = np.minimum(here, last)
        some = final >= first
        found.append((here[some], first[some], final[some] - first[some] + 1))
    final = np.minimum(at - far - 1, last)
    counts = np.maximum(0, final - before)
    alone = np.repeat(before + 1 - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    found.append((alone, alone, np.ones(len(alone), np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found))


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of a buffer of texts: begin, end, rows, and their text's begin and end inside; long texts come in overlapping pieces."""
    long_enough = np.flatnonzero(np.diff(offsets) >= SPAN)
    rows: list[int] = []

    def flush():
        lo, hi = offsets[rows[0]], offsets[rows[-1] + 1]
        own = np.array(rows)
        return lo, hi, own, offsets[own] - lo, offsets[own + 1] - lo

    for k in long_enough.tolist():
        size = offsets[k + 1] - offsets[k]
        if rows and offsets[k + 1] - offsets[rows[0]] > CHUNK:
            yield flush()
            rows = []
        if size <= CHUNK:
            rows.append(k)
            continue
        for a in range(offsets[k], offsets[k + 1] - SPAN + 1, CHUNK):
            b = min(a + CHUNK + SPAN - 1, offsets[k + 1])
            yield a, b, np.array([k]), np.array([0]), np.array([b - a])
    if rows:
        yield flush()


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def homeward(refs: np.ndarray, firsts: np.ndarray, counts: np.ndarray, kind: int, buckets: int) -> pa.RecordBatch:
    """Records (home, kind, refs, firsts, counts): runs of strings by the bucket that gathers their texts' answers."""
    home = (refs % buckets).astype(np.int64)
    order = np.argsort(home, kind="stable")
    home, refs, firsts, counts = home[order], refs[order], firsts[order].astype("<i4"), counts[order].astype("<i1")
    cuts = np.flatnonzero(np.diff(home)) + 1
    parts = list(zip([0, *cuts], [*cuts, len(home)])) if len(home) else []
    return pa.RecordBatch.from_arrays(
        [pa.array([int(home[a]) for a, _ in parts], pa.int64()), pa.array([kind] * len(parts), pa.int32()),
         *[pa.array([x[a:b].tobytes() for a, b in parts], pa.binary()) for x in (refs, firsts, counts)]],
        names=["home", "kind", "refs", "firsts", "counts"])


SENT = "bucket long, names binary, contexts binary, refs binary, firsts binary, counts binary"
TOLD = "home long, kind int, refs binary, firsts binary, counts binary"


def messages(buckets: int, names, contexts, refs, firsts, counts) -> Iterator[pa.RecordBatch]:
    """One record for each bucket, and one for what repeats within these texts and needs no answer (no names).

    Strings with the same name and context go as one; a negative count says that they repeat already.
    """
    both = names ^ (contexts * FACTOR)
    order = np.argsort(both, kind="stable")
    new = np.concatenate([[True], np.diff(both[order]) != 0]) if len(order) else np.zeros(0, bool)
    sizes = np.diff(np.append(np.flatnonzero(new), len(order)))
    repeats = np.repeat(sizes, sizes) > 1
    settled, one = order[repeats], order[new]
    sign = np.where(sizes > 1, -1, 1)
    bucket = (names[one] % np.uint64(buckets)).astype(np.int64)
    turn = np.argsort(bucket, kind="stable")
    one, sign, bucket = one[turn], sign[turn], bucket[turn]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    rows = [(int(bucket[a]), names[one[a:b]].tobytes(), contexts[one[a:b]].tobytes(), refs[one[a:b]].tobytes(),
             firsts[one[a:b]].astype("<i4").tobytes(), (counts[one[a:b]] * sign[a:b]).astype("<i1").tobytes())
            for a, b in zip([0, *cuts], [*cuts, len(one)]) if b > a]
    if len(settled):
        rows.append((int(refs[settled[0]] % buckets), b"", b"", refs[settled].tobytes(),
                     firsts[settled].astype("<i4").tobytes(), counts[settled].astype("<i1").tobytes()))
    for k in range(0, len(rows), 64):
        columns = list(zip(*rows[k:k + 64]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), *[pa.array(x, pa.binary()) for x in columns[1:]]],
            names=["bucket", "names", "contexts", "refs", "firsts", "counts"])


def cover(texts: DataFrame, buckets: int) -> DataFrame:
    """Sampled suffixes of all texts as messages."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ref = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = buffer(batch.column(1))
            for lo, hi, rows, starts, ends in chunks(offsets):
                of = fingerprints(data[lo:hi])
                at, first, count = sampled(of[TRIGGER], starts, ends)
                text = np.searchsorted(starts, first, side="right") - 1
                strings = of[SPAN]
                context = joined(joined(strings[first], strings[first + count - 1]), (count * 1024 + at - first).astype(np.uint64))
                held.append((of[AHEAD][at], context, ref[rows][text], first + lo - offsets[rows][text], count))
                size += hi - lo
                if size >= FLUSH:
                    yield from messages(buckets, *map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if held:
            yield from messages(buckets, *map(np.concatenate, zip(*held)))

    return texts.mapInArrow(work, SENT)


def answers(sent: DataFrame, buckets: int) -> DataFrame:
    """What the sorted names tell of each text, (ref, settled, open): runs of strings that repeat, and runs to be sorted one by one.

    A run is a pair of 32-bit numbers, the position of its first string and the number of strings.
    """

    def work(table: pa.Table) -> pa.Table:
        parts = {n: [x.as_py() for x in table.column(n)] for n in ("names", "contexts", "refs", "firsts", "counts")}
        kinds = {"names": "<u8", "contexts": "<u8", "refs": "<i8", "firsts": "<i4", "counts": "<i1"}
        asked = [bool(x) for x in parts["names"]]
        get = lambda n, which: np.frombuffer(b"".join(x for x, y in zip(parts[n], asked) if y == which), kinds[n])
        told = [homeward(get("refs", False), get("firsts", False), get("counts", False), 0, buckets)]
        names, contexts, refs, firsts, counts = (get(n, True) for n in kinds)
        if len(names):
            order = np.lexsort((contexts, names))
            names, contexts, refs, firsts, counts = (x[order] for x in (names, contexts, refs, firsts, counts))
            new_name = np.concatenate([[True], np.diff(names) != 0])
            new = new_name | np.concatenate([[True], np.diff(contexts) != 0])
            sizes = np.diff(np.append(np.flatnonzero(new), len(new)))
            group = np.cumsum(new) - 1
            settled = (sizes[group] > 1) & (counts > 0)
            told.append(homeward(refs[settled], firsts[settled], counts[settled], 0, buckets))
            of_name = np.cumsum(new_name) - 1
            several = (np.bincount(of_name, new) > 1)[of_name] & new
            told.append(homeward(refs[several], firsts[several], np.abs(counts[several]), 1, buckets))
        return pa.Table.from_batches(told)

    def gather(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b"".join(table.column(n).to_pylist()), t) for n, t in (("refs", "<i8"), ("firsts", "<i4"), ("counts", "<i1"))]
        sizes = [len(x) // 8 for x in table.column("refs").to_pylist()]
        kind = np.repeat(table.column("kind").to_numpy(), sizes)
        order = np.lexsort((kind, parts[0]))
        refs, kind = parts[0][order], kind[order]
        pairs = np.stack([parts[1], parts[2].astype("<i4")], axis=1)[order]
        starts = np.flatnonzero(np.concatenate([[True], np.diff(refs) != 0])) if len(refs) else np.zeros(0, int)
        ends = np.append(starts[1:], len(refs)).astype(int)
        halves = [a + int((kind[a:b] == 0).sum()) for a, b in zip(starts, ends)]
        return pa.table([pa.array(refs[starts]), pa.array([pairs[a:h].tobytes() for a, h in zip(starts, halves)], pa.binary()),
                         pa.array([pairs[h:b].tobytes() for h, b in zip(halves, ends)], pa.binary())], names=["ref", "settled", "open"])

    told = sent.groupBy("bucket").applyInArrow(work, TOLD)
    return cut(told.groupBy("home").applyInArrow(gather, "ref long, settled binary, open binary"))


def strings_of(texts: DataFrame, buckets: int) -> DataFrame:
    """The strings of open runs as messages, each by its own name."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for ref, text, runs in zip(*(batch.column(k) for k in range(3))):
                data = np.frombuffer(text.as_py(), np.uint8)
                for first, count in np.frombuffer(runs.as_py(), "<i4").reshape(-1, 2).tolist():
                    held.append((ref.as_py(), first, data[first:first + count + SPAN - 1]))
                    size += count + SPAN
                if size >= CHUNK * 4:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    def flush(held):
        found = []
        for k in range(0, len(held), 4096):
            part = held[k:k + 4096]
            lengths = np.array([len(x) for _, _, x in part])
            counts = lengths - SPAN + 1
            begins = np.cumsum(lengths) - lengths
            within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            names = fingerprints(np.concatenate([x for _, _, x in part]))[SPAN][np.repeat(begins, counts) + within]
            refs = np.repeat(np.array([x for x, _, _ in part]), counts)
            found.append((names, np.zeros(len(names), np.uint64), refs,
                          np.repeat(np.array([x for _, x, _ in part]), counts) + within, np.ones(len(names), np.int64)))
        yield from messages(buckets, *map(np.concatenate, zip(*found)))

    return texts.mapInArrow(work, SENT)


def spans_of(runs: list[bytes]) -> np.ndarray:
    """Merged [begin, end) spans of the bytes that runs of strings cover."""
    pairs = np.frombuffer(b"".join(runs), "<i4").reshape(-1, 2).astype(np.int64)
    if not len(pairs):
        return pairs
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    begin, end = pairs[:, 0], np.maximum.accumulate(pairs[:, 0] + pairs[:, 1] + SPAN - 1)
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    last = np.concatenate([new[1:], [True]])
    return np.stack([begin[new], end[last]], axis=1)


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """`docs` with a column `__ref`, and rows (ref, n_removed, n_spans, kept_sha256[, kept_text]) of the texts that lose bytes."""
    source = docs.withColumn("__ref", F.xxhash64(F.col(key), F.col(text)))
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(size // BUCKET) + 1)
    texts = source.select(F.col("__ref").alias("ref"), whole.alias("body")).where(F.octet_length("body") >= SPAN)
    found = cut(texts.join(answers(cover(texts, buckets), buckets), "ref"))
    late = answers(strings_of(found.where(F.octet_length("open") > 0).select("ref", "body", "open"), buckets), buckets)
    late = late.select("ref", F.col("settled").alias("late"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for ref, body, settled, later in zip(*(batch.column(k) for k in range(4))):
                spans = spans_of([settled.as_py(), later.as_py() or b""])
                if not len(spans):
                    continue
                data = memoryview(body.as_py())
                kept = b"".join(data[a:b] for a, b in zip([0, *spans[:, 1].tolist()], [*spans[:, 0].tolist(), len(data)]))
                for column, value in zip(rows, (ref.as_py(), int((spans[:, 1] - spans[:, 0]).sum()), len(spans),
                                                sha256(kept).hexdigest(), kept.decode(errors="ignore") if with_text else None)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                names=["ref", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    lost = found.join(late, "ref", "left").select("ref", "body", "settled", "late").mapInArrow(
        work, "ref long, n_removed long, n_spans long, kept_sha256 string, kept_text string").dropDuplicates(["ref"])
    return source, lost if with_text else lost.drop("kept_text")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_bytes, n_removed, n_spans, kept_sha256) of all documents."""
    source, lost = repeats(docs, key, text)
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    plain = source.select(key, F.col("__ref").alias("ref"), F.octet_length(whole).cast("long").alias("n_bytes"), F.sha2(whole, 256).alias("whole"))
    return plain.join(lost, "ref", "left").select(
        key, "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with the repeated bytes cut from their texts; what a cut leaves of a character goes with it."""
    source, lost = repeats(docs, key, text, with_text=True)
    lost = lost.select(F.col("ref").alias("__ref"), F.col("n_removed").alias("__removed"), F.col("kept_text").alias("__kept"))
    cut_text = F.when(F.col("__removed").isNull(), F.col(text)).otherwise(F.col("__kept"))
    return source.join(lost, "__ref", "left").withColumn(text, cut_text).select(*docs.columns)
