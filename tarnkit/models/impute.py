"""Multiple imputation by chained random forests with predictive mean matching."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnkit.models.forest import in_flight
from tarnkit.operators.joins import bind_by_key, equi_join, lookup_join
from tarnkit.operators.ordering import positions, running
from tarnkit.session import cut


def match_donors(
    donors: DataFrame, recipients: DataFrame, key: str, prediction: str, observed: str, k: int = 5, seed: int = 1,
    pieces: int | None = None,
) -> DataFrame:
    """Give each recipient the observed value of one of the k donors with the nearest predictions.

    Donors are numbered along the prediction, equal ones in the order of a seeded hash. For each distinct recipient prediction the k donors on either
    side are looked up by number, the k nearest kept, and a seeded hash of the recipient's key picks one. No
    pair of donor and recipient is formed beyond those 2k. Where k donors or more have the recipient's own prediction, all of them are
    nearest and the recipient's hash picks among all. Both tables must be stored or repeatable.
    Returns (key, observed).
    """
    tie = F.xxhash64(F.col(key), F.lit(seed)).alias("_tie")
    numbered = positions(
        donors.select(key, observed, F.col(prediction).alias("_dp"), tie), [], "_dp", ["_tie", key], "_at", pieces=pieces
    )
    counts = donors.select(F.col(prediction).alias("_p"), F.lit(1).cast("bigint").alias("_d"), F.lit(0).alias("_r"))
    counts = counts.unionByName(
        recipients.select(F.col(prediction).alias("_p"), F.lit(0).cast("bigint").alias("_d"), F.lit(1).alias("_r"))
    ).groupBy("_p").agg(F.sum("_d").alias("_d"), F.max("_r").alias("_r"))
    places = running(counts, [], "_p", sums={"_below": F.col("_d")}, pieces=pieces).filter(F.col("_r") == 1)
    tied = places.filter(F.col("_d") >= k).select(F.col("_p").alias(prediction), "_below", "_d")
    offset = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.col("_d"))
    at_tie = lookup_join(recipients.select(key, prediction), tied, prediction, "inner", derived=True).select(
        key, (F.col("_below") - F.col("_d") + 1 + offset).alias("_at"))
    from_tie = at_tie.join(numbered.select("_at", observed), "_at").select(key, observed)
    places = places.filter(F.col("_d") < k)
    around = places.select("_p", F.explode(F.sequence(F.col("_below") - (k - 1), F.col("_below") + k)).alias("_at"))
    near = around.join(numbered, "_at").groupBy("_p").agg(
        F.array_sort(F.collect_list(F.struct(F.abs(F.col("_dp") - F.col("_p")), "_at", observed))).alias("_c")
    )
    lists = near.select(F.col("_p").alias(prediction), F.slice(F.col(f"_c.{observed}"), 1, k).alias("_c"))
    joined = lookup_join(recipients.select(key, prediction), lists, prediction, "inner", derived=True)
    pick = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.size("_c")).cast("int") + 1
    return joined.select(key, F.element_at("_c", pick).alias(observed)).unionByName(from_tie)


def _start_values(df: DataFrame, numbers: Sequence[str], texts: Sequence[str]) -> dict:
    """Median of each number and most frequent text, as driver constants."""
    medians = df.approxQuantile(list(numbers), [0.5], 0.001) if numbers else []
    start = {c: m[0] for c, m in zip(numbers, medians) if m}
    if texts:
        modes = df.agg(*[F.mode(c).alias(c) for c in texts]).first()
        start |= {c: modes[c] for c in texts if modes[c] is not None}
    return start


def _prepared(view: DataFrame, column: str, texts: Sequence[str], inputs: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Features of all rows, and the label where ``column`` is a text, with the names of its classes."""
    coded = [c for c in inputs if c in texts]
    stages = [StringIndexer(inputCol=c, outputCol=f"_i_{c}", handleInvalid="keep") for c in coded]
    assembled = [f"_i_{c}" if c in coded else c for c in inputs]
    stages.append(VectorAssembler(inputCols=assembled, outputCol="_features", handleInvalid="error"))
    if column in texts:
        stages.append(StringIndexer(inputCol=column, outputCol="_label", stringOrderType="alphabetAsc"))
    fitted = Pipeline(stages=stages).fit(view)
    return fitted.transform(view), list(fitted.stages[-1].labels) if column in texts else []


def _scored(data: DataFrame, column: str, labels: Sequence[str], subs: int, trees: int, depth: int, bins: int, seed: int) -> DataFrame:
    """Rows with `_prediction`: of all sub-forests where ``column`` is missing, else of the one that has not seen the row.

    Each of ``subs`` forests grows its share of the trees on the observed rows outside its hashed part (column `_sub`).
    """
    common = dict(featuresCol="_features", numTrees=max(1, trees // subs), maxDepth=depth, maxBins=bins)
    scored, each = data, []
    for b in range(subs):
        seen = data.filter(~F.col("_gap") & (F.col("_sub") != b) if subs > 1 else ~F.col("_gap"))
        if labels:
            model = RandomForestClassifier(labelCol="_label", probabilityCol=f"_p{b}", rawPredictionCol=f"_raw{b}", predictionCol=f"_c{b}", seed=seed + b, **common)
        else:
            model = RandomForestRegressor(labelCol=column, predictionCol=f"_p{b}", seed=seed + b, **common)
        scored = model.fit(seen).transform(scored)
        each.append(vector_to_array(f"_p{b}") if labels else F.col(f"_p{b}"))
    if labels:
        sums = F.array(*[sum((x[j] for x in each[1:]), each[0][j]) for j in range(len(labels))])
        own = F.coalesce(*[F.when(F.col("_sub") == b, x) for b, x in enumerate(each)])
        chances = F.when(F.col("_gap"), sums).otherwise(own)
        names = F.array(*[F.lit(v) for v in labels])
        prediction = F.element_at(names, F.array_position(chances, F.array_max(chances)).cast("int"))
    else:
        mean = sum(each[1:], each[0]) / subs
        prediction = F.when(F.col("_gap"), mean).otherwise(F.coalesce(*[F.when(F.col("_sub") == b, x) for b, x in enumerate(each)]))
    return scored.select("_key", column, "_gap", prediction.alias("_prediction"))


def _error(scored: DataFrame, column: str, text: bool) -> float:
    """Share of wrong texts, or of a number's variance that is left, over the observed rows."""
    known = scored.filter(~F.col("_gap"))
    if text:
        return float(known.agg(F.avg((F.col("_prediction") != F.col(column)).cast("double"))).first()[0])
    left, spread = known.agg(F.avg(F.pow(F.col("_prediction") - F.col(column), 2.0)), F.var_pop(column)).first()
    return float(left / spread) if spread else 0.0


def merge_changes(state: DataFrame, changes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The values of incomplete rows (imp, key, columns) with those of a sweep's changes (imp, key, one or more columns) put in, stored."""
    found = changes.groupBy("imp", "_key").agg(*[F.first(c, ignorenulls=True).alias(f"_new_{c}") for c in columns])
    joined = state.join(found, ["imp", "_key"], "left")
    return cut(joined.select("imp", "_key", *[F.coalesce(f"_new_{c}", c).alias(c) for c in columns]))


def impute_stacked(
    df: DataFrame,
    key: str,
    columns: Sequence[str],
    predictors: Sequence[str] = (),
    seeds: Mapping[int, int] = {1: 1},
    sweeps: int = 2,
    trees: int = 100,
    depth: int = 8,
    k: int = 5,
    bins: int = 32,
    pieces: int | None = None,
    subsamples: int = 3,
    stop: bool = True,
    at_once: int = 2,
) -> DataFrame:
    """Completed tables (imp, key, predictors, columns), one for each number and seed in ``seeds``, without missing values.

    Every incomplete column starts from its median or mode. Columns are then re-predicted in turn, from the least incomplete on, each from
    all others by forests grown on the rows where it is observed. A number is replaced by the observed value of a donor whose prediction, by trees
    that have not seen it, is near; a text by the predicted class. ``predictors`` must be complete; ``bins`` must exceed the number of
    different texts in any text column.

    The table is stored once. What changes are the values of rows with gaps, a table of its own: a column's new values are stored as they
    are found, and merged into it once a sweep for all imputations, of which ``at_once`` are fitted side by side. With ``stop``, an imputation ends
    with the first sweep whose out-of-bag error, a mean over the columns, is not below that of the sweep before, and keeps the sweep before.
    """
    columns, predictors = list(columns), list(predictors)
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    typed = df.select(F.col(key).alias("_key"), *predictors, *[F.col(c) if c in texts else F.col(c).cast("double").alias(c) for c in columns])
    base = cut(typed)
    counts = base.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns]).first()
    order = sorted((c for c in columns if counts[c]), key=lambda c: counts[c])
    imps = F.explode(F.array(*map(F.lit, seeds))).alias("imp")
    if not order:
        return base.select(imps, F.col("_key").alias(key), *predictors, *columns)
    start = _start_values(base, [c for c in order if c not in texts], [c for c in order if c in texts])
    holes = base.filter(F.greatest(*[F.col(c).isNull() for c in order]))
    state = cut(holes.select(imps, "_key", *[F.coalesce(F.col(c), F.lit(start[c])).alias(c) for c in order]))

    def view(imp: int, changed: list[DataFrame]) -> DataFrame:
        """The imputation's whole table as it stands, with `_gap_` flags."""
        values = state.filter(F.col("imp") == imp).select("_key", *[F.col(c).alias(f"_v_{c}") for c in order])
        rows = equi_join(base, values, "_key", "left")
        done = [c for x in changed for c in x.columns if c not in ("imp", "_key")]
        if done:
            newest = changed[0]
            for x in changed[1:]:
                newest = newest.unionByName(x, allowMissingColumns=True)
            newest = newest.groupBy("_key").agg(*[F.first(c, ignorenulls=True).alias(f"_n_{c}") for c in done])
            rows = equi_join(rows, newest, "_key", "left")
        now = {c: F.coalesce(c, *([f"_n_{c}"] if c in done else []), f"_v_{c}").alias(c) for c in order}
        return rows.select("_key", *predictors, *[now.get(c, F.col(c)) for c in columns], *[F.col(c).isNull().alias(f"_gap_{c}") for c in order])

    def refreshed(imp: int, sweep: int, number: int, changed: list[DataFrame]) -> tuple[DataFrame, float]:
        column, seed = order[number], seeds[imp] * 1000 + sweep * 100 + number
        text, inputs = column in texts, [c for c in (*predictors, *columns) if c != column]
        subs = subsamples if counts["_rows"] - counts[column] >= 20 * subsamples else 1
        rows = view(imp, changed).withColumns({"_gap": F.col(f"_gap_{column}"), "_sub": F.pmod(F.xxhash64("_key", F.lit(seed)), F.lit(subs))})
        data, labels = _prepared(rows, column, texts, inputs)
        data = data.select("_key", column, "_gap", "_sub", "_features", *(["_label"] if text else [])).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            scored = _scored(data, column, labels, subs, trees, depth, bins, seed).persist(StorageLevel.MEMORY_AND_DISK)
            error = _error(scored, column, text) if stop else 0.0
            filled = scored.filter("_gap").select("_key", F.col("_prediction").alias(column))
            if not text:
                filled = match_donors(scored.filter("not _gap"), scored.filter("_gap"), "_key", "_prediction", column, k, seed, pieces)
            return cut(filled.select(F.lit(imp).alias("imp"), "_key", column)), error
        finally:
            scored.unpersist()
            data.unpersist()

    going, errors = list(seeds), {}
    for sweep in range(sweeps):
        def swept(imp: int) -> tuple[list[DataFrame], float]:
            changed, total = [], 0.0
            for number in range(len(order)):
                filled, error = refreshed(imp, sweep, number, changed)
                changed.append(filled)
                total += error / len(order)
            return changed, total

        results = dict(zip(going, in_flight(going, swept, at_once)))
        going = [imp for imp in going if not stop or results[imp][1] < errors.get(imp, math.inf)]
        errors = {imp: results[imp][1] for imp in going}
        tables = [x for imp in going for x in results[imp][0]]
        if not tables:
            break
        changes = tables[0]
        for x in tables[1:]:
            changes = changes.unionByName(x, allowMissingColumns=True)
        for c in order:
            changes = changes if c in changes.columns else changes.withColumn(c, F.lit(None))
        state = merge_changes(state, changes, order)
    values = state.select("imp", "_key", *[F.col(c).alias(f"_v_{c}") for c in order])
    whole = base.select(imps, "*").join(values, ["imp", "_key"], "left")
    return whole.select("imp", F.col("_key").alias(key), *predictors, *[F.coalesce(c, f"_v_{c}").alias(c) if c in order else F.col(c) for c in columns])


def impute_once(df: DataFrame, key: str, columns: Sequence[str], predictors: Sequence[str] = (), seed: int = 1, **options) -> DataFrame:
    """One completed table (key, predictors, columns); options as of ``impute_stacked``."""
    return impute_stacked(df, key, columns, predictors, {1: seed}, **options).drop("imp")


def impute_multiple(
    df: DataFrame,
    key: str,
    columns: Sequence[str],
    predictors: Sequence[str] = (),
    attach: Sequence[str] = (),
    imputations: int = 25,
    **options,
) -> DataFrame:
    """Stack of completed tables with ``imp`` from 1, responses and limits (``attach``) bound back by key."""
    seed = options.pop("seed", 1)
    stacked = impute_stacked(df, key, columns, predictors, {imp: seed * 100 + imp for imp in range(1, imputations + 1)}, **options)
    stacked = stacked.select(key, *predictors, *columns, "imp")
    return bind_by_key(stacked, df.select(key, *attach), key) if attach else stacked
