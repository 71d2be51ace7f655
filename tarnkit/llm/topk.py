"""Exact top-k inner products of quantised vectors by a bit-sliced index.

Rows are dealt into blocks; a block keeps, for each attribute and binary digit, the bitmap of rows whose value has that digit. A
query's weighted sum of attributes is added up for all rows of a block at once with carry-save adders on bitmaps, the query's
weights written in signed digits so that few additions remain; a negative digit adds the complement. From the most significant slice of
the sums downward the rows are found that are surely among the best, and those that still tie; the ties at the boundary are
resolved by identifier, and the scores of the rows found are computed exactly. Blocks of queries meet blocks of rows; what
each pair finds, k rows a query, is merged.

Defined results: vectors that are null or hold a null or a non-finite component take no part. Only vectors of equal length are compared.
Rows with the query's own identifier, and rows without one, are no candidates. Repeated queries are answered once. Inner
products must fit 64 bits. Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnkit.llm.tables import cut

ROW_BLOCK, QUERY_BLOCK, SCALE = 8192, 1024, 256


class BitSlices:
    """Bitmaps of a block's rows by binary digit and attribute."""

    def __init__(self, values: np.ndarray):
        self.rows, self.values = len(values), values
        shifted = (values - values.min(axis=0)).T if len(values) else values.T
        digits = int(shifted.max()).bit_length() if shifted.size else 0
        self.words = -(-self.rows // 64)
        self.slices = np.zeros((digits, values.shape[1], self.words), np.uint64)
        for k in range(digits):
            packed = np.packbits(((shifted >> k) & 1).astype(np.uint8), axis=1, bitorder="little")
            self.slices[k].view(np.uint8)[:, :packed.shape[1]] = packed
        self.all = bitmap(np.ones(self.rows, bool), self.words)

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the weighted sums, up to a constant."""
        columns: dict[int, list[np.ndarray]] = {}
        rest, place = query.copy(), 0
        while rest.any():
            odd = rest & 1 == 1
            digit = np.where(odd, 2 - (rest & 3), 0)
            plus, minus = self.slices[:, digit == 1], ~self.slices[:, digit == -1]
            for k in range(len(self.slices)):
                columns.setdefault(place + k, []).extend([plus[k], minus[k]])
            rest, place = (rest - digit) >> 1, place + 1
        out, place = [], 0
        while place <= max(columns, default=-1):
            terms = np.concatenate(columns.pop(place, [np.zeros((1, self.words), np.uint64)]))
            carries = []
            while len(terms) > 1:
                third = max(1, len(terms) // 3)
                a, b = terms[:third], terms[third:2 * third]
                either = a ^ b
                if len(terms) == 2:
                    terms = either
                    carries.append(a & b)
                else:
                    c = terms[2 * third:3 * third]
                    carries.append((a & b) | (either & c))
                    terms = np.concatenate([either ^ c, terms[3 * third:]])
            out.append(terms[0] if len(terms) else np.zeros(self.words, np.uint64))
            if carries:
                columns.setdefault(place + 1, []).extend(carries)
            place += 1
        return out

    def top(self, query: np.ndarray, k: int, allowed: np.ndarray) -> np.ndarray:
        """Rows with the k largest sums among the allowed ones, earlier rows first among equals."""
        sure, tied = np.zeros(self.words, np.uint64), allowed
        for one in reversed(self.sums(query)):
            upper = tied & one
            n = int(np.bitwise_count(sure | upper).sum())
            if n > k:
                tied = upper
            else:
                sure, tied = sure | upper, tied & ~one
                if n == k:
                    return places(sure)
        have = places(sure)
        return np.concatenate([have, places(tied)[:k - len(have)]])


def bitmap(flags: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words, np.uint64)
    packed = np.packbits(flags, bitorder="little")
    out.view(np.uint8)[:len(packed)] = packed
    return out


def places(bits: np.ndarray) -> np.ndarray:
    """Positions of set bits, ascending."""
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


def best_of_blocks(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k best rows of one block for each query of one block."""
    def matrix(table):
        ids = table.column("id").to_numpy()
        flat = table.column("vector").combine_chunks().values.to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        return ids[order], flat.reshape(len(ids), -1)[order] if len(ids) else np.zeros((0, 0), np.int64)

    ids, values = matrix(rows)
    asked, weights = matrix(queries)
    found: list[list] = [[], [], []]
    if len(ids) and len(asked):
        index = BitSlices(values)
        for q, weight in zip(asked.tolist(), weights):
            own = slice(*np.searchsorted(ids, [q, q + 1]))
            allowed = index.all
            if own.stop > own.start:
                flags = np.ones(len(ids), bool)
                flags[own] = False
                allowed = bitmap(flags, index.words)
            best = index.top(weight, k, allowed)
            found[0] += [q] * len(best)
            found[1] += ids[best].tolist()
            found[2] += (values[best] @ weight).tolist()
    return pa.table([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])


def quantised(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (id, vector) with integer components, where all components are finite and there is an identifier."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & fine).select(
        F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)).alias("vector"))


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for rows whose key is divisible by `every`, the k best other rows."""
    rows = cut(quantised(vectors, key, vector))
    queries = rows.where(F.col("id") % every == 0).dropDuplicates(["id"])
    sizes = rows.agg(F.count("*"), F.count_distinct(F.when(F.col("id") % every == 0, F.col("id")))).first()
    row_blocks, query_blocks = (max(1, round(n / size)) for n, size in zip(sizes, (ROW_BLOCK, QUERY_BLOCK)))
    dealt = F.xxhash64(F.monotonically_increasing_id())
    length = F.size("vector").alias("length")
    left = rows.select("id", "vector", length, F.pmod(dealt, F.lit(row_blocks)).alias("row_block")).withColumn(
        "query_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))
    right = queries.select("id", "vector", length, F.pmod(F.xxhash64("id"), F.lit(query_blocks)).alias("query_block")).withColumn(
        "row_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))))
    pair = ["length", "row_block", "query_block"]
    found = left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInArrow(
        lambda a, b: best_of_blocks(a, b, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
