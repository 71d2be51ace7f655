"""All bootstrap replicates of the detection model at once, by Newton steps on sums over the rows.

The model is that of ``detection``: a ridge logistic regression with an intercept (not penalised), an effect and a slope for each location,
and shared terms: years, season and the common slope. One pass over the rows sums, for every replicate, gradients and second
derivatives. A location's own two terms touch only each other and the shared ones, so each location is eliminated by itself
(2 x 2 blocks) and only the shared system, of a few terms a replicate, is solved on the driver. Its size is replicates x (years + 6)
squared, whatever the number of rows and locations; coefficients by location stay a table.

A location of few rows is one stored row. Each pass finds its own two terms anew, the best under the shared terms as they stand, and
adds its part to the sums of the task: nothing by location is stored or shuffled between passes. A large location is summed in
pieces, and its sums and terms are tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnkit.models.detection import with_season
from tarnkit.operators.joins import BROADCAST_BYTES, BROADCAST_ROWS, lookup_join, small_side
from tarnkit.session import cut, shuffle_pieces

#: Replicates whose sums travel together, rows summed in one piece and at once, partial sums merged in one group.
BLOCK, PIECE_ROWS, CHUNK, FAN = 250, 20_000, 1000, 64
#: Numbers in one array of rows (or location terms) by replicates, and steps within which a location's own terms must settle.
CELLS, OWN_STEPS = 1 << 18, 100
MOST_YEARS = 200
SEASON = ("sin1", "cos1", "sin2", "cos2")


@dataclass(frozen=True)
class Coefficients:
    """One value for each replicate, in arrays.

    by_location: (location, base, slope, own, own_slope, sin1, cos1, sin2, cos2), where `own` and `own_slope` are the location's deviations from the
    common intercept and slope, and the season's terms are the same for all; by_year: (year, effect). A replicate whose rows all have one
    outcome has no finite fit; its values are NULL. What is stored is own_terms (location, own, own_slope) and common, one row with the
    season's terms, the common slope and the intercept.
    """

    by_location: DataFrame
    by_year: DataFrame
    replicates: int
    passes: int
    own_terms: DataFrame
    common: DataFrame


def poisson_weights(hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Weights of rows (by their xxhash64) in the replicates of `seeds`, equal to `detection.poisson_weight` of the hashed key.

    Spark hashes several values by folding: the hash of the key is the seed under which the 32-bit replicate number is hashed.
    """
    one, two, three, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    mixed = (hashes.view(np.uint64)[:, None] + five + np.uint64(4)) ^ ((seeds.astype(np.uint64) & np.uint64(0xFFFFFFFF)) * one)[None, :]
    mixed = ((mixed << np.uint64(23)) | (mixed >> np.uint64(41))) * two + three
    mixed = (mixed ^ (mixed >> np.uint64(33))) * two
    mixed = (mixed ^ (mixed >> np.uint64(29))) * three
    uniform = ((mixed ^ (mixed >> np.uint64(32))) & np.uint64((1 << 52) - 1)) / float(1 << 52)
    reached, term, bounds = 0.0, math.exp(-1), []
    for n in range(1, 16):
        reached += term
        term /= n
        bounds.append(reached)
    return np.searchsorted(bounds, uniform, side="right")


def design(batch: pa.Table, years: int) -> np.ndarray:
    """Shared terms of each row: intercept, years, season, predictor."""
    year = np.zeros((batch.num_rows, years))
    year[np.arange(batch.num_rows), batch.column("year").to_numpy()] = 1
    columns = [batch.column(c).to_numpy() for c in (*SEASON, "x")]
    return np.column_stack([np.ones(batch.num_rows), year, *columns])


def sums_of(batch: pa.Table, base: np.ndarray, slope: np.ndarray, shared: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """(terms + pairs of terms + 1) x replicates: gradients, second derivatives and weights of the rows of one location."""
    terms = shared.shape[1]
    i, j = np.triu_indices(terms)
    out = np.zeros((terms + len(i) + 1, len(seeds)))
    for k in range(0, batch.num_rows, CHUNK):
        part = batch.slice(k, CHUNK)
        rows, label = design(part, terms - 6), part.column("label").to_numpy()
        weight = poisson_weights(part.column("hash").to_numpy(), seeds).astype(float)
        chance = 1 / (1 + np.exp(-(rows @ shared.T + base + rows[:, -1:] * slope)))
        out[:terms] += rows.T @ (weight * (label[:, None] - chance))
        out[terms:-1] += (rows[:, i] * rows[:, j]).T @ (weight * chance * (1 - chance))
        out[-1] += weight.sum(axis=0)
    return out


class Eliminated:
    """One location's sums with its own effect and slope eliminated, for each replicate of a block."""

    def __init__(self, sums: np.ndarray, base: np.ndarray, slope: np.ndarray, ridge: np.ndarray):
        """`ridge` is the penalty times the weight of all rows of the replicate."""
        count = len(sums)
        self.terms = terms = int((math.isqrt(9 + 8 * (count - 1)) - 3) // 2)
        i, j = np.triu_indices(terms)
        self.whole = np.zeros((sums.shape[1], terms, terms))
        self.whole[:, i, j] = self.whole[:, j, i] = sums[terms:-1].T
        self.gradient = sums[:terms].T
        own = [0, terms - 1]
        self.cross = self.whole[:, own, :]
        block = self.whole[:, own][:, :, own] + ridge[:, None, None] * np.eye(2)
        self.inverse = np.linalg.inv(block)
        self.own_gradient = self.gradient[:, own] - ridge[:, None] * np.stack([base, slope], axis=1)

    def contribution(self) -> np.ndarray:
        """(terms + pairs of terms) x replicates: what the location adds to the shared system."""
        lever = self.cross.transpose(0, 2, 1) @ self.inverse
        i, j = np.triu_indices(self.terms)
        gradient = self.gradient - (lever @ self.own_gradient[:, :, None])[:, :, 0]
        return np.concatenate([gradient.T, (self.whole - lever @ self.cross)[:, i, j].T])

    def step(self, shared: np.ndarray) -> np.ndarray:
        """Steps of effect and slope that go with a step of the shared terms."""
        rest = self.own_gradient - (self.cross @ shared[:, :, None])[:, :, 0]
        return (self.inverse @ rest[:, :, None])[:, :, 0]


def whole_locations(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch, np.ndarray]]:
    """Slices of a batch's locations of about `CHUNK` rows: first and last location, their rows, and where each location starts."""
    column = batch.column("rows")
    ends = column.offsets.to_numpy() - column.offsets[0].as_py()
    rows, first = pa.RecordBatch.from_struct_array(column.flatten()), 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + CHUNK, side="right")) - 1)
        yield first, last, rows.slice(ends[first], ends[last] - ends[first]), ends[first:last] - ends[first]
        first = last


def few_replicates(rows: int, locations: int, terms: int, replicates: int) -> Iterator[slice]:
    size = max(1, CELLS // max(rows, 2 * terms * locations))
    return (slice(k, min(k + size, replicates)) for k in range(0, replicates, size))


class Profile:
    """Rows of whole locations with the locations' own terms at their best under the shared ones, for a few replicates."""

    def __init__(self, rows: np.ndarray, starts: np.ndarray, label: np.ndarray, weight: np.ndarray, shared: np.ndarray, ridge: np.ndarray):
        """`weight` is replicates x rows; `ridge` as for `Eliminated`. Own terms are zero until `settle`."""
        self.rows, self.starts, self.label, self.weight, self.ridge = rows, starts, label, weight, ridge[:, None]
        self.x, self.given = rows[:, -1], shared @ rows.T
        self.lengths = np.diff(np.append(starts, len(rows)))
        self.own = np.zeros((2, len(weight), len(starts)))
        self.evaluate()

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts, axis=1)

    def evaluate(self) -> None:
        effect, slope = (np.repeat(x, self.lengths, axis=1) for x in self.own)
        chance = 1 / (1 + np.exp(-(self.given + effect + slope * self.x)))
        self.left, self.curve = self.weight * (self.label - chance), self.weight * chance * (1 - chance)
        curve_x = self.curve * self.x
        gradient = [self.sums(v) - self.ridge * own for v, own in zip((self.left, self.left * self.x), self.own)]
        one, both, two = self.sums(self.curve), self.sums(curve_x), self.sums(curve_x * self.x)
        a, c = one + self.ridge, two + self.ridge
        self.curve_x, self.known = curve_x, (one, both, two)
        self.inverse = np.stack([c, -both, a]) / (a * c - both * both)
        self.last = c
        self.step = np.stack([self.inverse[0] * gradient[0] + self.inverse[1] * gradient[1],
                              self.inverse[1] * gradient[0] + self.inverse[2] * gradient[1]])

    def settle(self, tolerance: float) -> None:
        """Newton steps, shortened as the logistic function's third derivative asks, until none moves a row by the tolerance."""
        wide = np.maximum.reduceat(np.abs(self.x), self.starts)
        for _ in range(OWN_STEPS):
            reach = np.abs(self.step[0]) + np.abs(self.step[1]) * wide
            if reach.max(initial=0) < tolerance:
                return
            self.own = self.own + self.step * (np.log1p(reach) / np.where(reach > 0, reach, 1.0))
            self.evaluate()
        raise ValueError(f"terms of a location have not settled after {OWN_STEPS} steps")

    def contribution(self) -> np.ndarray:
        """(terms + pairs of terms) x replicates: what the locations add to the shared system, their own terms eliminated."""
        terms, (one, both, two) = self.rows.shape[1], self.known
        replicates, locations = one.shape
        i, j = np.triu_indices(terms)
        cross = np.zeros((2, replicates, locations, terms))
        cross[0, :, :, 0], cross[0, :, :, -1], cross[1, :, :, 0], cross[1, :, :, -1] = one, both, both, two
        for t in range(1, terms - 1):
            column = self.rows[:, t]
            if column.any():
                cross[0, :, :, t], cross[1, :, :, t] = self.sums(self.curve * column), self.sums(self.curve_x * column)
        gradient = self.left @ self.rows
        for k in (0, 1):
            gradient -= (self.step[k][:, None, :] @ cross[k])[:, 0, :]
        whole = 0
        few = max(1, (4 * CELLS) // len(i))
        for k in range(0, len(self.rows), few):
            part = self.rows[k:k + few]
            whole = whole + self.curve[:, k:k + few] @ (part[:, i] * part[:, j])
        root = np.sqrt(self.inverse[0])
        lever = np.concatenate([root[..., None] * cross[0] + (self.inverse[1] / root)[..., None] * cross[1],
                                cross[1] / np.sqrt(self.last)[..., None]], axis=1)
        whole = whole - (lever.transpose(0, 2, 1) @ lever)[:, i, j]
        return np.concatenate([gradient.T, whole.T])


def summed(table: pa.Table, keys: Sequence[str]) -> pa.Table:
    """One row with the sum of all rows' numbers in the column `sums`."""
    total = 0
    for x in table.column("sums"):
        total = total + np.frombuffer(x.as_py())
    first = table.slice(0, 1)
    return pa.table([*(first.column(c) for c in keys), pa.array([total.tobytes()], pa.binary())], names=[*keys, "sums"])


def merged(parts: DataFrame, keys: Sequence[str], count: int) -> DataFrame:
    """Sums (column `sums`) by keys; at most `FAN` of the parts (column `part`, below `count`) meet in one group at a time."""
    while True:
        count = -(-count // FAN)
        parts = parts.withColumn("part", F.expr(f"part div {FAN}"))
        columns = [*keys, "part"]
        schema = ", ".join(f"`{c}` {parts.schema[c].dataType.simpleString()}" for c in columns) + ", sums binary"
        parts = parts.groupBy(*columns).applyInArrow(lambda table: summed(table, columns), schema)
        if count <= 1:
            return parts.drop("part")


def known_rows(df: DataFrame, key: str, label: Column, location: str, year: str, week: str, x: str) -> DataFrame:
    """Rows (location, _year, label, season, x, hash) with a known outcome, location, year, week and ``x``."""
    return with_season(df, week).select(
        F.col(location).cast("string").alias("location"), F.col(year).cast("string").alias("_year"), label.cast("double").alias("label"),
        *[F.col(f"_{c}").alias(c) for c in SEASON], F.col(x).cast("double").alias("x"), F.xxhash64(key).alias("hash"),
    ).dropna()


def bootstrap_coefficients(
    df: DataFrame, key: str, label: Column, location: str, year: str, week: str, x: str, replicates: int,
    ridge: float = 0.01, seed: int = 1543, most_passes: int = 10, tolerance: float = 1e-9,
) -> Coefficients:
    """Coefficients of every replicate of the rows with a known outcome, location, year, week and ``x``.

    The rows are read once for each Newton step, all replicates together. Raises where a replicate with both outcomes does not settle.
    """
    known = cut(known_rows(df, key, label, location, year, week, x))
    names = [r["_year"] for r in known.select("_year").distinct().limit(MOST_YEARS + 1).collect()]
    if not names or len(names) > MOST_YEARS:
        raise ValueError("no complete rows" if not names else f"over {MOST_YEARS} years")
    names = sorted(names)
    number = (F.array_position(F.array(*map(F.lit, names)), F.col("_year")) - 1).cast("int").alias("year")
    counts = cut(known.groupBy("location").agg(F.expr(f"(count(*) - 1) div {PIECE_ROWS} + 1").alias("pieces"), F.count(F.lit(1)).alias("n")))
    few, values = PIECE_ROWS // 10, ["label", *SEASON, "x", "hash"]
    most, n_large, n_small = counts.agg(F.max("pieces"), F.count_if(F.col("n") > few), F.count_if(F.col("n") <= few)).first()
    sized = lookup_join(known, counts, "location", "inner").select("location", "pieces", "n", number, *values)
    small = cut(sized.where(F.col("n") <= few).groupBy("location").agg(F.collect_list(F.struct("year", *values)).alias("rows"))) if n_small else None
    large = counts.where(F.col("n") > few)
    piece = F.pmod(F.xxhash64("hash"), F.col("pieces")).alias("part")
    rows = cut(sized.where(F.col("n") > few).select("location", piece, "year", *values)) if n_large else None
    blocks = -(-replicates // BLOCK)
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    zeros = F.array_repeat(F.lit(0.0), F.least(F.lit(BLOCK), F.lit(replicates) - F.col("block") * BLOCK))
    local = cut(large.select("location", "pieces", each).withColumns({"base": zeros, "slope": zeros}))
    shared, passes, seeds = np.zeros((replicates, len(names) + 6)), 0, seed + np.arange(replicates)

    def of_block(values: np.ndarray, block: int) -> np.ndarray:
        return values[block * BLOCK:(block + 1) * BLOCK]

    def arrays(table: pa.Table | pa.RecordBatch, row: int) -> list[np.ndarray]:
        return [table.column(c)[row].values.to_numpy() for c in ("base", "slope")]

    def eliminated(batch: pa.RecordBatch, row: int) -> tuple[int, Eliminated]:
        block, numbers = batch.column("block")[row].as_py(), np.frombuffer(batch.column("sums")[row].as_py())
        base, slope = arrays(batch, row)
        return block, Eliminated(numbers.reshape(-1, len(base)), base, slope, of_block(penalty, block))

    def collected(table: DataFrame, one) -> np.ndarray:
        """Sums over all rows of a table, terms x replicates; `one` gives those of a batch as (block, numbers)."""

        def work(batches):
            from pyspark import TaskContext

            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for block, numbers in one(batch):
                    total[block] = total.get(block, 0) + numbers
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array([part] * len(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())],
                names=["block", "part", "sums"])

        parts = table.mapInArrow(work, "block int, part long, sums binary")
        found = {r["block"]: np.frombuffer(r["sums"]) for r in merged(parts, ["block"], table.rdd.getNumPartitions()).collect()}
        return np.concatenate([found[k].reshape(-1, min(BLOCK, replicates - k * BLOCK)) for k in range(blocks)], axis=1)

    def by_block(numbers: np.ndarray):
        return [(k, np.ascontiguousarray(numbers[:, k * BLOCK:(k + 1) * BLOCK])) for k in range(blocks)]

    def weighed(batch: pa.RecordBatch):
        total = np.zeros((2, replicates))
        for k in range(0, batch.num_rows, CHUNK):
            part = batch.slice(k, CHUNK)
            for some in few_replicates(part.num_rows, 0, 0, replicates):
                weight = poisson_weights(part.column("hash").to_numpy(), seeds[some])
                total[:, some] += np.stack([weight.sum(axis=0), part.column("label").to_numpy() @ weight])
        return by_block(total)

    weight, detected = collected(known.select("label", "hash"), weighed)
    fitted = np.abs(detected - weight / 2) < weight / 2 * (1 - 1e-12)
    penalty = ridge * np.where(weight > 0, weight, 1.0)

    def profiles(batch: pa.RecordBatch):
        for first, last, part, starts in whole_locations(batch):
            terms, label, hashes = design(part, len(names)), part.column("label").to_numpy(), part.column("hash").to_numpy()
            for some in few_replicates(len(terms), last - first, terms.shape[1], replicates):
                weights = poisson_weights(hashes, seeds[some]).T.astype(float)
                yield slice(first, last), some, Profile(terms, starts, label, weights, shared[some], penalty[some])

    def added(batch: pa.RecordBatch):
        total = 0
        for _, some, profile in profiles(batch):
            if passes > 1:
                profile.settle(1e-4)
            numbers = profile.contribution()
            if isinstance(total, int):
                total = np.zeros((len(numbers), replicates))
            total[:, some] += numbers
        return [] if isinstance(total, int) else by_block(total)

    while True:
        passes += 1

        def work(own: pa.Table, state: pa.Table) -> pa.Table:
            block = state.column("block")[0].as_py()
            numbers = sums_of(own, *arrays(state, 0), of_block(shared, block), of_block(seeds, block))
            return pa.table([state.column(c).slice(0, 1) for c in ("location", "block", "part")] + [pa.array([numbers.tobytes()], pa.binary())],
                            names=["location", "block", "part", "sums"])

        total = collected(small, added) if n_small else 0
        if n_large:
            states = local.withColumn("part", F.explode(F.expr("sequence(0L, pieces - 1)"))).select("location", "block", "part", "base", "slope")
            groups = ["location", "block", "part"]
            parts = rows.select("*", each).groupBy(*groups).cogroup(states.groupBy(*groups)).applyInArrow(
                work, "location string, block int, part long, sums binary")
            found = cut(merged(parts, ["location", "block"], most).join(local, ["location", "block"]))
            total = total + collected(found, lambda batch: ((k, e.contribution()) for k, e in (eliminated(batch, row) for row in range(batch.num_rows))))
        terms = shared.shape[1]
        i, j = np.triu_indices(terms)
        system = np.zeros((replicates, terms, terms))
        system[:, i, j] = system[:, j, i] = total[terms:].T
        free = np.r_[0.0, np.ones(terms - 1)]
        system += penalty[:, None, None] * np.diag(free)
        system[~fitted] += np.eye(terms)
        gradient = total[:terms].T - penalty[:, None] * free * shared
        step = np.where(fitted[:, None], np.linalg.solve(system, gradient[:, :, None])[:, :, 0], 0.0)

        def moved(batches):
            for batch in batches:
                states = [arrays(batch, row) for row in range(batch.num_rows)]
                steps = []
                for row in range(batch.num_rows):
                    block, one = eliminated(batch, row)
                    steps.append(np.where(of_block(fitted, block)[:, None], one.step(of_block(step, block)), 0.0).T)
                new = [[x[k] + y[k] for x, y in zip(states, steps)] for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("location", "pieces", "block")), *(pa.array(x, pa.list_(pa.float64())) for x in new),
                     pa.array([float(np.abs(x).max(initial=0)) for x in steps], pa.float64())],
                    names=["location", "pieces", "block", "base", "slope", "step"])

        largest = float(np.abs(step).max())
        if n_large:
            state = cut(found.mapInArrow(moved, "location string, pieces long, block int, base array<double>, slope array<double>, step double"))
            largest = max(largest, state.agg(F.max("step")).first()[0])
            local = state.drop("step")
        shared = shared + step
        if largest < tolerance:
            break
        if passes == most_passes:
            raise ValueError(f"replicates have not settled after {passes} passes (last step {largest:.3g})")

    def settled(batches):
        for batch in batches:
            own = np.zeros((2, batch.num_rows, replicates))
            for some_locations, some, profile in profiles(batch):
                profile.settle(tolerance)
                own[:, some_locations, some] = np.where(fitted[some][:, None], profile.own + profile.step, 0.0).transpose(0, 2, 1)
            yield pa.RecordBatch.from_arrays([batch.column("location"), *(pa.array(list(x), pa.list_(pa.float64())) for x in own)], names=["location", "own", "own_slope"])

    spark = df.sparkSession
    finite = np.where(fitted[:, None], shared, np.nan)
    listed = lambda column: [None if math.isnan(v) else float(v) for v in finite[:, column]]
    by_year = spark.createDataFrame([(name, listed(1 + k)) for k, name in enumerate(names)], "year string, effect array<double>")
    terms = [listed(1 + len(names) + k) for k in range(5)]
    common = spark.createDataFrame([(*terms, listed(0))], ", ".join(f"{c} array<double>" for c in (*SEASON, "common", "intercept")))
    whole = local.groupBy("location").agg(F.sort_array(F.collect_list(F.struct("block", "base", "slope"))).alias("found"))
    whole = whole.select("location", F.flatten("found.base").alias("own"), F.flatten("found.slope").alias("own_slope"))
    if n_small:
        whole = whole.unionByName(small.mapInArrow(settled, "location string, own array<double>, own_slope array<double>"))
    own_terms = cut(whole)
    plus = lambda a, b: F.zip_with(a, b, lambda u, v: u + v)
    by_location = own_terms.crossJoin(F.broadcast(common)).select(
        "location", plus("own", "intercept").alias("base"), plus("own_slope", "common").alias("slope"), "own", "own_slope", *SEASON)
    return Coefficients(by_location, by_year, replicates, passes, own_terms, common)


def with_terms(rows: DataFrame, found: Coefficients, location: Column, year: Column, partitions: int | None = None) -> DataFrame:
    """Rows with the arrays of all replicates: `_b_location`, `_b_own`, `_b_own_slope`, `_b_year`, `_b_effect` and the common ones.

    ``partitions`` is the number by which ``rows`` were dealt out by location, if they were.
    """
    own = found.own_terms.select(*[F.col(c).alias(f"_b_{c}") for c in found.own_terms.columns])
    by_year = found.by_year.select(F.col("year").alias("_b_year"), F.col("effect").alias("_b_effect"))
    common = found.common.select(*[F.col(c).alias(f"_b_{c}") for c in found.common.columns])
    if partitions:
        own = own.repartition(partitions, "_b_location")
    rows = rows.join(small_side(own, min(BROADCAST_ROWS, BROADCAST_BYTES // (16 * found.replicates))), location == F.col("_b_location"), "left")
    return rows.join(F.broadcast(by_year), year == F.col("_b_year"), "left").crossJoin(F.broadcast(common))


def draws_of(found: Coefficients, grid: DataFrame, location: str, year: str, week: str, x: str) -> DataFrame:
    """The draws table (location, year, week, draw, x, p): all replicates evaluated on the whole grid.

    p is NULL where the location or the year was never fitted. A grid is small beside its draws: its rows are dealt out by number, as
    adaptive execution would give them all to one task for their few bytes.
    """
    cells = with_season(grid, week).withColumn("_l", F.col(location).cast("string")).repartition(shuffle_pieces(grid.sparkSession), "_l")
    cells = with_terms(cells, found, F.col("_l"), F.col(year).cast("string"), shuffle_pieces(grid.sparkSession))
    cells = cells.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(found.replicates - 1))))
    at = lambda name: F.get(f"_b_{name}", "_at")
    logit = (at("own") + at("intercept")) + at("effect") + (at("own_slope") + at("common")) * F.col(x)
    for term in SEASON:
        logit = logit + at(term) * F.col(f"_{term}")
    return cells.withColumn("_logit", logit).select(
        F.col(location).alias("location"), F.col(year).alias("year"), F.col(week).alias("week"), (F.col("_at") + 1).alias("draw"),
        F.col(x).alias("x"), (1 / (1 + F.exp(-F.col("_logit")))).alias("p"))


def score_equations(
    df: DataFrame, found: Coefficients, key: str, label: Column, location: str, year: str, week: str, x: str,
    ridge: float = 0.01, seed: int = 1543,
) -> DataFrame:
    """Rows (draw, kind, name, score): the derivative of each replicate's penalised likelihood by each of its terms, a row's mean; zero at the fit.

    Rows are summed by location and year, a large location in pieces, for all replicates at once; only these sums are spread by replicate.
    """
    known = cut(known_rows(df, key, label, location, year, week, x))
    pieces = known.groupBy("location").agg(F.expr(f"(count(*) - 1) div {PIECE_ROWS // 10} + 1").alias("pieces"))
    piece = F.pmod(F.xxhash64("hash"), F.col("pieces")).alias("part")
    sized = lookup_join(known, pieces, "location", "inner", derived=True).select("location", "_year", piece, "label", *SEASON, "x", "hash")
    groups = sized.groupBy("location", "_year", "part").agg(F.collect_list(F.struct("label", *SEASON, "x", "hash")).alias("rows"))
    groups = with_terms(groups, found, F.col("location"), F.col("_year")).drop("location", "_year", "part")
    replicates, seeds = found.replicates, seed + np.arange(found.replicates)
    lefts = ["left", *[f"left_{c}" for c in (*SEASON, "x")]]
    kept = ["_b_location", "_b_year", "_b_own", "_b_own_slope"]

    def work(batches):
        for batch in batches:
            for first, last, part, starts in whole_locations(batch):
                out = np.zeros((1 + len(lefts), last - first, replicates))
                terms = [np.array([[np.nan] * replicates if x is None else x for x in batch.column(f"_b_{c}").slice(first, last - first).to_pylist()], float)
                         for c in ("own", "own_slope", "effect")]
                columns = [part.column(c).to_numpy() for c in (*SEASON, "x")]
                common = {c: np.array(batch.column(f"_b_{c}")[first].as_py(), float) for c in (*SEASON, "common", "intercept")}
                lengths = np.diff(np.append(starts, part.num_rows))
                for some in few_replicates(part.num_rows, last - first, 0, replicates):
                    own, slope, effect = (np.repeat(t[:, some].T, lengths, axis=1) for t in terms)
                    logit = own + common["intercept"][some, None] + effect + (slope + common["common"][some, None]) * columns[-1]
                    for c, values in zip(SEASON, columns):
                        logit += common[c][some, None] * values
                    weight = poisson_weights(part.column("hash").to_numpy(), seeds[some]).T.astype(float)
                    left = weight * (part.column("label").to_numpy() - 1 / (1 + np.exp(-logit)))
                    for k, values in enumerate([weight, left, *(left * v for v in columns)]):
                        out[k, :, some] = np.add.reduceat(values, starts, axis=1).T
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, last - first) for c in kept), *(pa.array(list(x), pa.list_(pa.float64())) for x in out)],
                    names=[*kept, "weight", *lefts])

    summed = cut(groups.mapInArrow(work, "_b_location string, _b_year string, " + ", ".join(f"{c} array<double>" for c in (*kept[2:], "weight", *lefts))))
    summed = summed.join(F.broadcast(found.by_year.select(F.col("year").alias("_b_year"), F.col("effect").alias("_b_effect"))), "_b_year", "left")
    common = found.common.select(*[F.col(c).alias(f"_b_{c}") for c in found.common.columns])
    spread = summed.crossJoin(F.broadcast(common)).withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    at = {c: F.get(f"_b_{c}", "_at") for c in ("own", "own_slope", "effect", *SEASON, "common")}
    sums = spread.select(
        (F.col("_at") + 1).alias("draw"), F.col("_b_location").alias("location"), F.col("_b_year").alias("year"),
        *[F.nanvl(F.get(c, "_at"), F.lit(None)).alias(c) for c in ("weight", *lefts)], *[v.alias(f"at_{c}") for c, v in at.items()])
    weights = cut(sums.groupBy("draw").agg(F.sum("weight").alias("whole")))

    def equations(keys: list[str], kind: str, name, terms: list[tuple[str, str | None, str]]) -> DataFrame:
        grouped = sums.groupBy("draw", *keys).agg(
            *[F.sum(gradient).alias(f"g{k}") for k, (gradient, _, _) in enumerate(terms)],
            *[F.first(f"at_{value}").alias(f"v{k}") for k, (_, value, _) in enumerate(terms) if value]).join(F.broadcast(weights), "draw")
        each = [F.struct(F.lit(label).alias("term"), ((F.col(f"g{k}") / F.col("whole")) - (ridge * F.col(f"v{k}") if value else 0)).alias("score"))
                for k, (_, value, label) in enumerate(terms)]
        spread = grouped.withColumn("_e", F.explode(F.array(*each)))
        return spread.select("draw", F.lit(kind).alias("kind") if kind else F.col("_e.term").alias("kind"), name.alias("name"), F.col("_e.score").alias("score"))

    shared = [("left", None, "intercept"), ("left_x", "common", "slope"), *[(f"left_{c}", c, c) for c in SEASON]]
    return equations(["location"], "", F.col("location"), [("left", "own", "location"), ("left_x", "own_slope", "location_slope")]).unionByName(
        equations(["year"], "year", F.col("year"), [("left", "effect", "year")])).unionByName(
        equations([], "shared", F.col("_e.term"), shared))
