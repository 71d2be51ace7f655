"""Packing of documents into sequences of a fixed number of tokens by the sum-of-squares rule.

A document that is longer than a sequence is cut; all pieces but its first are full. Full pieces fill a sequence alone. The rest is dealt
by a hash of its place in the stored table into groups of bounded size, and each group is packed in decreasing length: a piece
goes to the gap, or to a new sequence where none has room, after which the sum over all gaps of the squared number of open
sequences with that gap is smallest. On 16,384 pieces of the test documents that takes at most two sequences more than their
total length needs, so groups cost nothing that counts.

Defined results: a null text is a document of no ids (then of the end id alone), an empty table packs into no sequences,
repeated rows are packed once each. Tokens are never dropped. Other columns of the input are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnkit.llm.bpe import read_source
from tarnkit.llm.ranks import loaded
from tarnkit.llm.tables import cut, extended, short_batches

#: Pieces that one task packs; more groups, not larger ones, serve more documents.
GROUP_PIECES = 16_384


def encoded_pieces(docs: DataFrame, path: str, size: int, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, piece, start, length, ids_crc32) of whole texts' ids with `end_id` after them, no piece longer than `size`.

    Ids go from the text to their digests in one worker; `path` is a JSON file of the byte-level kind.
    """
    short_batches(docs.sparkSession)
    source = docs.sparkSession.sparkContext.broadcast(read_source(path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = loaded(source.value, special=True)
        for batch in batches:
            rows: list[tuple] = []
            for k, x in enumerate(batch.column(1)):
                ids = array("I", words.encode(x.as_py() or "", allowed_special="all", disallowed_special=()))
                ids.append(end_id)
                first = (len(ids) - 1) % size + 1
                bounds = [0, *range(first, len(ids) + 1, size)]
                rows += [(k, piece, a, b - a, crc32(ids[a:b])) for piece, (a, b) in enumerate(zip(bounds, bounds[1:]))]
            if rows:
                row, *columns = zip(*rows)
                kinds = (pa.int32(), *[pa.int64()] * 3)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int32())), *[pa.array(x, t) for x, t in zip(columns, kinds)]],
                    names=[key, "piece", "start", "length", "ids_crc32"])

    return docs.select(key, text).mapInArrow(work, extended(docs, [key], "piece int, start long, length long, ids_crc32 long"))


def place(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length, by sum of squares in decreasing length."""
    open_by_gap = np.zeros(size + 1, np.int64)
    members: list[list[int]] = [[] for _ in range(size + 1)]
    used, sequence, offset = 0, np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k in np.argsort(-lengths, kind="stable"):
        n = int(lengths[k])
        gaps = np.flatnonzero(open_by_gap[n:]) + n
        if len(gaps):
            after = open_by_gap[gaps - n]
            after[gaps == n] = 0
            gap = int(gaps[np.argmin(after - open_by_gap[gaps])])
            bin_ = members[gap].pop()
            open_by_gap[gap] -= 1
        else:
            gap, bin_, used = size, used, used + 1
        sequence[k], offset[k] = bin_, size - gap
        if gap > n:
            open_by_gap[gap - n] += 1
            members[gap - n].append(bin_)
    return sequence, offset


def pack(pieces: DataFrame, size: int, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """`pieces` with sequence_id and offset. They should be stored: they are counted first and dealt by their place."""
    full = pieces.where(F.col("length") == size).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < size)
    groups = max(1, round(rest.count() / group_pieces))
    schema = extended(pieces, pieces.columns, "sequence_id long, offset long")

    def work(part: pd.DataFrame) -> pd.DataFrame:
        group = int(part["part"].iloc[0])
        sequence, offset = place(part["length"].to_numpy(), size)
        return part.drop(columns="part").assign(sequence_id=sequence * groups + group, offset=offset)

    dealt = rest.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return full.unionByName(dealt.groupBy("part").applyInPandas(work, schema))


def pack_documents(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all documents."""
    pieces = cut(encoded_pieces(docs, path, size, end_id))
    return pack(pieces, size)
