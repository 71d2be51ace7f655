"""Exact join of documents whose sets of shingles have a Jaccard similarity of `least` or more, and the groups that links form.

The Jaccard distance is a metric, but whole documents can't be split by pivots: unrelated ones are all at distance near 1 from every
pivot, so that a window of twice the radius takes in every region (the README has figures). Regions are therefore made in two steps:

1. The universe of shingles is cut by hash into slices of a few shingles each. A pair within the radius differs in at most D shingles,
   a share of its size, and so in at most D slices; where a document has more than D slices, the pair agrees in one. In a slice the
   metric is discrete at that radius: a pivot stands for the documents that have its very shingles there, its Voronoi region has
   radius zero. Of its slices a document enters the D + 1 whose regions are smallest (both documents of a pair then enter a common one).
   Documents with that many slices of their own have no partner. The number of slices follows the size; sizes come in classes, and a
   document near the lower bound of its class enters the class below as well.
2. A region of several documents is joined recursively (`joined`): far apart pivots make Voronoi regions, and a document is replicated into
   each region that its triangle-inequality window reaches (distance to the pivot at most that to its own plus twice the radius).
   The distance is that of counts of shingles in `BUCKETS` buckets, a metric on multisets that never exceeds the true one, so no pair
   is lost. Where a split would not halve the work, pairs are compared directly. Regions of over `REGION` documents are dealt to tasks in
   pairs of blocks.

Candidates are verified on the sets themselves. Each round gives candidates only for documents that no links join yet, and only a few
for each document of a region, so that a large group of near copies costs a few links for each, not all pairs; a region that had more is
joined again with a larger bound, until none is left.

Equal sets are one node with a 128-bit name; shingles are 64-bit hashes. Defined results: letters A-Z are lower-cased, words are runs
without space or control white space; a null text is an empty one. Fewer words than a shingle are one shingle together. A document without
words has an empty set, is linked with nothing and is its own component; rows are told apart by their ids there. A row without an
id can link others but is never the smallest of them: a group of such rows alone has a null component. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnkit.llm.components import components
from tarnkit.llm.simhash import lists, shingle_hashes
from tarnkit.llm.tables import cut, extended, short_batches

#: Mean shingles of a slice at the lower bound of a class of sizes; from `WIDE_FROM` shingles on, where shares vary less, they are wider.
SLICE, WIDE, WIDE_FROM = 4.2, 5.6, 200
#: Size below which each shingle is a slice, and the ratio of class bounds.
SINGLE, RATIO = 40, 1.5
BUCKETS, REGION, LEAF, PIVOTS = 32, 2048, 96, 64
#: Rows of one number that are broadcast at most.
FEW_ROWS = 500_000


def class_of(size: int) -> int:
    """Number of the class of sizes; each reaches `RATIO` times as far as the one before."""
    bound, k = SINGLE, 0
    while size >= bound:
        bound, k = int(bound * RATIO) + 1, k + 1
    return k


def lower_bound(number: int) -> int:
    bound = SINGLE if number else 0
    for _ in range(number - 1):
        bound = int(bound * RATIO) + 1
    return bound


def slice_names(shingles: np.ndarray, number: int, fineness: int) -> np.ndarray:
    """Names of the shingles of each slice that has any, in class `number` with 2 ** `fineness` times the usual slices."""
    bound = lower_bound(number)
    count = int(bound / (SLICE if bound < WIDE_FROM else WIDE)) << fineness
    mixed = shingles * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(2 * number)
    mixed ^= mixed >> np.uint64(29)
    if not 0 < count < 1 << 31:
        return mixed
    own = ((shingles >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
    return np.add.reduceat(mixed, np.flatnonzero(np.append(True, own[1:] != own[:-1])))


def differing(size: int, least: tuple[int, int]) -> int:
    """Most shingles that a set of `size` and a partner can differ in."""
    return size * (least[1] - least[0]) // least[0]


def sets_of(docs: DataFrame, key: str, text: str, width: int, least: tuple[int, int], fineness: dict[int, int]) -> DataFrame:
    """Rows (key, of, node, size, slices, short): each text's set by its 128-bit name, and for its classes the names of its slices.

    `of` is a hash of key and text, `short` a class in which the set has too few slices for its size (else null).
    """
    kind = pa.list_(pa.struct([("class", pa.int32()), ("names", pa.list_(pa.int64()))]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, slices, short = [], [], [], []
            for x in batch.column(2):
                own = np.unique(shingle_hashes(x.as_py(), width))
                size = len(own)
                high, low = class_of(size), class_of(-(-size * least[0] // least[1]))
                found = [(k, slice_names(own, k, fineness.get(k, 0))) for k in range(low, high + 1)] if size >= least[0] else []
                nodes.append(xxhash.xxh128_digest(own.tobytes()))
                sizes.append(size)
                slices.append([{"class": k, "names": names.view(np.int64)} for k, names in found])
                short.append(high if found and len(found[-1][1]) <= differing(size, least) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(slices, kind), pa.array(short, pa.int32())],
                names=[key, "of", "node", "size", "slices", "short"])

    return docs.select(key, F.xxhash64(key, text).alias("of"), text).mapInArrow(
        work, extended(docs, [key], "of long, node binary, size long, slices array<struct<class: int, names: array<long>>>, short int"))


def sliced(docs: DataFrame, key: str, text: str, width: int, least: tuple[int, int]) -> DataFrame:
    """`sets_of` with the coarsest slices that give every document of a class enough of them; each row has a number of its own."""
    fineness: dict[int, int] = {}
    while True:
        rows = sets_of(docs, key, text, width, least, fineness)
        rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
        short = [r["short"] for r in rows.where("short is not null").select("short").distinct().collect()]
        if not short:
            return rows.drop("short")
        for k in short:
            fineness[k] = fineness.get(k, 0) + 1


def entered(nodes: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Rows (region, row): the smallest regions of each node, one more than a partner can differ in, where others stand too."""
    slices = nodes.select("row", "size", F.explode("slices").alias("x")).select("row", "size", "x.class", "x.names")
    own = slices.select("row", "class", F.explode("names").alias("region"))
    sizes = own.groupBy("region").agg(F.count("*").alias("n")).where("n > 1")
    shared = own.join(sizes, "region").groupBy("row", "class").agg(F.sort_array(F.collect_list(F.struct("n", "region"))).alias("shared"))
    most = F.expr(f"size * {least[1] - least[0]} div {least[0]} + 1") - F.size("names") + F.size("shared")
    chosen = slices.join(shared, ["row", "class"]).withColumn("most", most.cast("int")).where("most > 0")
    chosen = cut(chosen.select("row", F.explode(F.slice("shared", F.lit(1), F.col("most"))).alias("x")).select("x.region", "row"))
    return chosen.join(chosen.groupBy("region").count().where("count > 1"), "region", "left_semi")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of sorted rows, cut between groups (the first column), with each row's place in its group and the group's rows."""
    held: list[list[np.ndarray]] = []
    for batch in chain((x for x in batches if x.num_rows), [None]):
        now = None if batch is None else [x.to_numpy(zero_copy_only=False) for x in batch.columns]
        if now is not None and held and held[-1][0][-1] == now[0][0] == now[0][-1]:
            held.append(now)
            continue
        if now is None:
            whole = held
            held = []
        else:
            begin = int(np.searchsorted(now[0], now[0][-1]))
            whole = [*held, [x[:begin] for x in now]]
            held = [[x[begin:] for x in now]]
        columns = [np.concatenate(x) for x in zip(*whole)]
        if columns and len(columns[0]):
            starts = np.flatnonzero(np.append(True, np.diff(columns[0]) != 0))
            sizes = np.diff(np.append(starts, len(columns[0])))
            yield *columns, np.arange(len(columns[0])) - np.repeat(starts, sizes), np.repeat(sizes, sizes)


def bucket_counts(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Counts of shingles by bucket, and of those that their 16 bits leave out."""
    counts = np.frombuffer(b"".join(rows), "<u2").reshape(len(rows), BUCKETS).astype(np.int32)
    return np.column_stack([counts, sizes - counts.sum(axis=1, dtype=np.int64)])


class Region:
    """Documents of one region: their counts, sizes and components, and the pairs found so far, as many as `bound` and a few."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, roots: np.ndarray, least: tuple[int, int], bound: int):
        self.counts, self.sizes, self.roots, self.least, self.bound = counts, sizes, roots, least, bound
        self.radius = 1 - least[0] / least[1]
        self.pairs, self.found, self.whole = [], 0, True

    def apart(self, one: int, others: np.ndarray) -> np.ndarray:
        """Summed differences between the counts of `one` and of each of `others`."""
        return np.abs(self.counts[others] - self.counts[one]).sum(axis=1)

    def direct(self, members: np.ndarray) -> None:
        """All pairs of members that may be linked and are not joined."""
        for k in range(len(members) - 1):
            if self.found >= self.bound:
                self.whole = False
                return
            one, others = members[k], members[k + 1:]
            others = others[self.roots[others] != self.roots[one]]
            near = may_link(self.apart(one, others), self.sizes[one] + self.sizes[others], self.least)
            if np.any(near):
                self.pairs.append(np.stack([np.full(int(near.sum()), one), others[near]], axis=1))
                self.found += int(near.sum())

    def join(self, members: np.ndarray) -> None:
        """Members split by pivots, replicated by their windows, and joined region by region."""
        if len(members) <= LEAF:
            self.direct(members)
            return
        pivots, nearest, far = [], None, []
        for _ in range(PIVOTS):
            pivot = members[0] if nearest is None else members[int(np.argmax(nearest))]
            summed = self.apart(pivot, members)
            distance = 2 * summed / (self.sizes[members] + self.sizes[pivot] + summed)
            nearest = distance if nearest is None else np.minimum(nearest, distance)
            pivots.append(pivot)
            far.append(distance)
            if nearest.max() <= self.radius:
                break
        regions = [members[x <= nearest + 2 * self.radius + 1e-9] for x in far]
        if sum(len(x) ** 2 for x in regions) > len(members) ** 2 / 2:
            self.direct(members)
            return
        for x in regions:
            self.join(x)


def may_link(summed: np.ndarray, sizes: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """Whether pairs with so many differing shingles at least, and sizes of that sum, can be as similar as `least`."""
    return summed * (least[1] + least[0]) <= (least[1] - least[0]) * sizes


def region_pairs(regions: DataFrame, least: tuple[int, int], factor: int) -> DataFrame:
    """Rows (region, a, b) of candidates; one with b = -1 more where a region has over `factor` of them for each of its documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for region, row, size, root, counts, place, n in whole_groups(batches):
            counts = bucket_counts(counts, size)
            twos = np.flatnonzero((place == 0) & (n == 2))
            summed = np.abs(counts[twos] - counts[twos + 1]).sum(axis=1)
            twos = twos[may_link(summed, size[twos] + size[twos + 1], least) & (root[twos] != root[twos + 1])]
            out = [(region[twos], row[twos], row[twos + 1])]
            for k in np.flatnonzero((place == 0) & (n > 2)).tolist():
                own = slice(k, k + int(n[k]))
                if (root[own] == root[k]).all():
                    continue
                found = Region(counts[own], size[own], root[own], least, factor * int(n[k]))
                found.join(np.arange(int(n[k])))
                pairs = np.sort(row[own][np.concatenate([np.zeros((0, 2), np.int64), *found.pairs])], axis=1)
                pairs = np.unique(pairs, axis=0)
                out.append((np.full(len(pairs), region[k]), pairs[:, 0], pairs[:, 1]))
                if not found.whole:
                    out.append((region[k:k + 1], row[k:k + 1], np.array([-1])))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["region", "a", "b"])

    rows = regions.select("region", "row", "size", "root", "counts")
    return rows.repartition("region").sortWithinPartitions("region", "row").mapInArrow(work, "region long, a long, b long")


def blocks(regions: DataFrame) -> DataFrame:
    """Regions of over `REGION` rows dealt in pairs of blocks, each a region of its own."""
    sizes = regions.groupBy("region").agg(F.count("*").alias("n")).where(F.col("n") > REGION)
    if sizes.isEmpty():
        return regions
    count = F.expr(f"2 * n div {REGION} + 1")
    large = regions.join(sizes, "region").withColumn("block", F.pmod(F.xxhash64("row"), count))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    named = F.xxhash64("region", F.least("block", "other"), F.greatest("block", "other")).alias("region")
    return regions.join(sizes, "region", "left_anti").unionByName(large.select(named, "row"))


def verified(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The pairs whose sets (row, shingles) are as similar as `least`."""
    one = sets.select(F.col("row").alias("a"), F.col("shingles").alias("of_a"))
    both = pairs.join(one, "a").join(sets.select(F.col("row").alias("b"), F.col("shingles").alias("of_b")), "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(least[1] * shared >= least[0] * (F.size("of_a") + F.size("of_b") - shared)).select("a", "b")


def whole_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """Rows (row, size, counts, shingles) of the wanted nodes (row, of, node), made from their texts again."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(x.as_py(), width)) for x in batch.column(0)]
            buckets = [np.bincount((x % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS) for x in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh128_digest(x.tobytes()) for x in found], pa.binary()), pa.array(list(map(len, found)), pa.int64()),
                 pa.array([np.minimum(x, 65535).astype("<u2").tobytes() for x in buckets], pa.binary()), lists([x.view(np.int64) for x in found])],
                names=["node", "size", "counts", "shingles"])

    keys = wanted.select("of").distinct()
    keys = F.broadcast(keys) if wanted.count() <= FEW_ROWS else keys
    texts = docs.select(F.xxhash64(key, text).alias("of"), text).join(keys, "of", "left_semi").select(text)
    made = texts.mapInArrow(work, "node binary, size long, counts binary, shingles array<long>")
    return made.join(wanted.select("row", "node"), "node").drop("node").dropDuplicates(["row"])


def linked(docs: DataFrame, nodes: DataFrame, key: str, text: str, width: int, least: tuple[int, int]) -> DataFrame:
    """Rows (a, b): links between nodes (row, of, node, size, slices) that join all that links of similarity `least` join."""
    regions = cut(blocks(entered(nodes, least)))
    wanted = cut(nodes.join(regions.select("row").distinct(), "row", "left_semi").select("row", "of", "node"))
    sets = cut(whole_sets(docs, wanted, key, text, width))
    traits, roots, found, factor = sets.select("row", "size", "counts"), sets.select("row", F.col("row").alias("root")), None, 1
    while True:
        rows = regions.join(traits.join(roots, "row"), "row")
        pairs = cut(region_pairs(rows, least, factor))
        good = verified(pairs.where("b >= 0").select("a", "b").distinct(), sets, least)
        found = cut(good if found is None else found.unionByName(good))
        open_ = pairs.where("b < 0").select("region").distinct()
        if open_.isEmpty():
            return found
        regions, factor = cut(regions.join(open_, "region", "left_semi")), 8 * factor
        roots = sets.select("row").join(components(found).withColumnRenamed("node", "row"), "row", "left").select(
            "row", F.coalesce("root", "row").alias("root"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, least: tuple[int, int] = (9, 10)) -> DataFrame:
    """Rows (key, n_shingles, component_id): each row's number of different shingles and the smallest key that links reach from it."""
    short_batches(docs.sparkSession)
    rows = sliced(docs, key, text, width, least)
    firsts = cut(rows.where("size > 0").groupBy("node").agg(F.min(key).alias("first"), F.min("row").alias("row")))
    nodes = rows.where(F.size("slices") > 0).join(firsts.select("row"), "row", "left_semi").select("row", "of", "node", "size", "slices")
    found = components(linked(docs, nodes, key, text, width, least)).select(F.col("node").alias("row"), "root")
    rooted = cut(firsts.join(found, "row", "left").select("node", "first", F.coalesce("root", "row").alias("root")))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("node", "component_id")
    return rows.join(named, "node", "left").select(
        key, F.col("size").alias("n_shingles"), F.when(F.col("size") == 0, F.col(key)).otherwise(F.col("component_id")).alias("component_id"))
