"""Random forests over hold-outs and imputations with Spark ML.

Each fit is a distributed job over its rows. The driver only loops over (hold-out, imputation, parameters) and
keeps a few fits in flight, so that a small fit does not leave the cluster idle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnkit.models.holdout import Holdout, add_fold, best_parameters, class_weights, regular_grid
from tarnkit.session import cut
from tarnkit.sources.tables import save_table


@dataclass(frozen=True)
class ForestSpec:
    """What to predict, from which columns, and how the trees are grown."""

    target: str
    features: tuple[str, ...]
    positive: str = "detected"
    mode: str = "classification"
    trees: int = 500
    mtry: int | None = None
    min_n: int = 2
    max_depth: int = 10
    seed: int = 101
    balanced: bool = True

    def label(self):
        column = F.col(self.target)
        return (column == F.lit(self.positive)).cast("double") if self.mode == "classification" else column.cast("double")


def assemble(df: DataFrame, spec: ForestSpec, keep: Sequence[str] = ()) -> DataFrame:
    """Rows with a known target as (keep, label, features, weight); the target's classes are balanced by weight."""
    known = df.filter(F.col(spec.target).isNotNull()).withColumn("label", spec.label())
    if spec.mode == "classification" and spec.balanced:
        known = class_weights(known, "label")
    else:
        known = known.withColumn("weight", F.lit(1.0))
    vectors = VectorAssembler(inputCols=list(spec.features), outputCol="features", handleInvalid="error")
    return vectors.transform(known).select(*keep, "label", "features", "weight")


def fit_forest(rows: DataFrame, spec: ForestSpec):
    """Grow one forest on assembled rows."""
    common = dict(
        labelCol="label", featuresCol="features", weightCol="weight", numTrees=spec.trees, maxDepth=spec.max_depth,
        minInstancesPerNode=spec.min_n, seed=spec.seed,
        featureSubsetStrategy="auto" if spec.mtry is None else str(spec.mtry),
    )
    kind = RandomForestClassifier if spec.mode == "classification" else RandomForestRegressor
    return kind(**common).fit(rows)


def predict(model, rows: DataFrame, spec: ForestSpec, keep: Sequence[str]) -> DataFrame:
    """(keep, score): probability of the positive class, or the predicted value."""
    scored = model.transform(rows)
    score = vector_to_array("probability")[1] if spec.mode == "classification" else F.col("prediction")
    return scored.select(*keep, score.alias("score"))


def importance_rows(name: str, imp: int, model, features: Sequence[str]) -> list[tuple[str, int, str, float]]:
    """(model, imp, variable, importance) of a fitted forest, one row per feature."""
    return [(name, imp, feature, float(value)) for feature, value in zip(features, model.featureImportances.toArray())]


def in_flight(tasks: Sequence, function: Callable, at_once: int) -> list:
    """Run the same driver-side step for several tasks with a bounded number in flight."""
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        return list(pool.map(function, tasks))


def run_holdouts(
    df: DataFrame,
    spec: ForestSpec,
    holdouts: Sequence[Holdout],
    imputations: Sequence[int],
    row_id: str,
    at_once: int = 4,
    path: str | None = None,
    tune: Mapping | None = None,
    chosen: Mapping[str, tuple[int, int]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Fit one forest per (hold-out, imputation) and predict its held-out rows.

    Returns predictions (model, imp, row_id, truth, score) and importances (model, imp, variable, importance).
    With ``path``, each fit's predictions are written to their own (model, imp) partition there as soon as they
    exist, and its forest is then dropped: the driver holds ``at_once`` forests at most. Running a fit again replaces its partition.
    With ``tune`` (arguments of ``tune_forest``), each hold-out first chooses mtry and min_n on its own training rows;
    ``chosen`` gives (mtry, min_n) by hold-out, as ``tune_holdouts`` finds them.
    """
    spark = df.sparkSession
    pairs = chosen or {}
    specs = {h.name: replace(spec, mtry=pairs[h.name][0], min_n=pairs[h.name][1]) if h.name in pairs else spec for h in holdouts}
    if tune is not None:
        for h in holdouts:
            (mtry, min_n), _ = tune_forest(h.train(df), spec, imputations, row_id, **tune)
            specs[h.name] = replace(spec, mtry=mtry, min_n=min_n)

    def one(task: tuple[Holdout, int]):
        holdout, imp = task
        table = df.filter(F.col("imp") == imp)
        train = assemble(holdout.train(table), spec).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            model = fit_forest(train, specs[holdout.name])
        finally:
            train.unpersist()
        test = holdout.test(table).filter(F.col(spec.target).isNotNull())
        vectors = VectorAssembler(inputCols=list(spec.features), outputCol="features", handleInvalid="error")
        keys = [F.lit(holdout.name).alias("model"), F.lit(imp).alias("imp"), F.col(row_id).alias("row_id"),
                F.col(spec.target).alias("truth")]
        scored = predict(model, vectors.transform(test), spec, keys)
        found = importance_rows(holdout.name, imp, model, spec.features)
        if path is None:
            return found, scored
        save_table(scored, path, ["model", "imp"], replace_partitions=True)
        return found, None

    done = in_flight([(h, i) for h in holdouts for i in imputations], one, at_once)
    rows = [row for found, _ in done for row in found]
    importances = spark.createDataFrame(rows, "model string, imp int, variable string, importance double")
    if path is not None:
        return spark.read.parquet(path).select("model", "imp", "row_id", "truth", "score"), importances
    predictions = done[0][1]
    for _, scored in done[1:]:
        predictions = predictions.unionByName(scored)
    return predictions, importances


def tune_forest(
    df: DataFrame,
    spec: ForestSpec,
    imputations: Sequence[int],
    row_id: str,
    grid: Sequence[tuple[int, int]] | None = None,
    folds: int = 5,
    repeats: int = 2,
    at_once: int = 4,
) -> tuple[tuple[int, int], DataFrame]:
    """Cross-validate a grid of (mtry, min_n) on every imputation.

    Returns the chosen pair and the table (imp, repeat, fold, mtry, min_n, metric, value). The assembled rows of
    an imputation are cached once; only the parameters vary over them. A fold without test rows has a NULL value.
    """
    grid = list(grid) if grid is not None else regular_grid(len(spec.features))
    metric = "accuracy" if spec.mode == "classification" else "rmse"
    results: list[tuple] = []
    for imp in imputations:
        rows = assemble(df.filter(F.col("imp") == imp), spec, [row_id])
        for repeat in range(repeats):
            rows = add_fold(rows, row_id, folds, spec.seed + repeat, f"fold_{repeat}")
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)

        def score(task: tuple[int, int, int, int]) -> tuple:
            repeat, fold, mtry, min_n = task
            at = F.col(f"fold_{repeat}") == fold
            tuned = ForestSpec(**{**spec.__dict__, "mtry": mtry, "min_n": min_n})
            scored = fit_forest(rows.filter(~at), tuned).transform(rows.filter(at))
            error = F.col("prediction") - F.col("label")
            value = F.avg((error == 0).cast("int")) if metric == "accuracy" else F.sqrt(F.avg(error * error))
            return (imp, repeat, fold, mtry, min_n, metric, scored.agg(value.alias("v")).first()["v"])

        tasks = [(r, f, m, n) for r in range(repeats) for f in range(folds) for m, n in grid]
        try:
            results += in_flight(tasks, score, at_once)
        finally:
            rows.unpersist()
    if all(r[-1] is None for r in results):
        raise ValueError("tuning gave no results; check the target and the predictors")
    schema = "imp int, repeat int, fold int, mtry int, min_n int, metric string, value double"
    metrics = df.sparkSession.createDataFrame(results, schema)
    best = best_parameters(metrics, metric).first()
    return (best["mtry"], best["min_n"]), metrics


_FIT_KEYS = ["model", "imp", "repeat", "fold", "mtry", "min_n"]
_FIT_SCHEMA = "metric string, value double, model string, imp int, repeat int, fold int, mtry int, min_n int"


def tune_holdouts(
    df: DataFrame,
    spec: ForestSpec,
    holdouts: Sequence[Holdout],
    imputations: Sequence[int],
    row_id: str,
    grid: Sequence[tuple[int, int]] | None = None,
    folds: int = 5,
    repeats: int = 2,
    at_once: int = 4,
    path: str | None = None,
) -> tuple[dict[str, tuple[int, int]], DataFrame]:
    """Cross-validate a grid of (mtry, min_n) on the training rows of every hold-out.

    Returns the chosen pair of each hold-out and the table (metric, value, model, imp, repeat, fold, mtry, min_n). Rows are
    assembled and stored once for all hold-outs and imputations; all fits wait in one queue, ``at_once`` of them in flight.
    With ``path`` each fit's value is stored there when it exists, and fits found there are not run again, so a
    driver that was lost goes on where it stopped. A fold without rows on either side has a NULL value.
    """
    spark = df.sparkSession
    grid = list(grid) if grid is not None else regular_grid(len(spec.features))
    metric = "accuracy" if spec.mode == "classification" else "rmse"
    rows, weights = _fold_table(df, spec, holdouts, imputations, row_id, folds, repeats)
    tasks = [
        (h.name, imp, r, f, m, n)
        for h in holdouts for imp in imputations for r in range(repeats) for f in range(folds) for m, n in grid
    ]
    done = _stored_fits(spark, path)
    at = {h.name: i for i, h in enumerate(holdouts)}

    def score(task: tuple) -> None:
        name, imp, repeat, fold, mtry, min_n = task
        inside = rows.filter((F.col("imp") == imp) & F.col(f"in_{at[name]}"))
        inside = inside.withColumn("weight", weights(at[name], imp))
        tested = F.col(f"fold_{repeat}") == fold
        train, test = inside.filter(~tested), inside.filter(tested)
        value = None
        if not train.isEmpty() and not test.isEmpty():
            scored = fit_forest(train, replace(spec, mtry=mtry, min_n=min_n)).transform(test)
            error = F.col("prediction") - F.col("label")
            measure = F.avg((error == 0).cast("int")) if metric == "accuracy" else F.sqrt(F.avg(error * error))
            value = scored.agg(measure.alias("v")).first()["v"]
        done[task] = value
        if path is not None:
            row = spark.createDataFrame([(metric, value, *task)], _FIT_SCHEMA)
            save_table(row, path, _FIT_KEYS, replace_partitions=True)

    in_flight([t for t in tasks if t not in done], score, at_once)
    metrics = spark.createDataFrame([(metric, done[t], *t) for t in tasks], _FIT_SCHEMA)
    chosen = {}
    for h in holdouts:
        if all(done[t] is None for t in tasks if t[0] == h.name):
            raise ValueError(f"tuning {h.name} gave no results; check the target and the predictors")
        best = best_parameters(metrics.filter(F.col("model") == h.name), metric).first()
        chosen[h.name] = (best["mtry"], best["min_n"])
    return chosen, metrics


def _fold_table(df, spec, holdouts, imputations, row_id, folds, repeats):
    """Assembled rows with their folds and whether each hold-out trains on them (in_0, in_1, ...), stored; and a
    function that gives the class weights of a hold-out and imputation as a column.
    """
    known = df.filter(F.col(spec.target).isNotNull() & F.col("imp").isin(list(imputations))).withColumn("label", spec.label())
    vectors = VectorAssembler(inputCols=list(spec.features), outputCol="features", handleInvalid="error").transform(known)
    inside = [h.trains().alias(f"in_{i}") for i, h in enumerate(holdouts)]
    rows = vectors.select("imp", F.col(row_id).alias("row_id"), "label", "features", *inside)
    for repeat in range(repeats):
        rows = add_fold(rows, "row_id", folds, spec.seed + repeat, f"fold_{repeat}")
    rows = cut(rows)
    if spec.mode != "classification" or not spec.balanced:
        return rows, lambda i, imp: F.lit(1.0)
    sizes = rows.groupBy("imp", "label").agg(*[F.count_if(f"in_{i}").alias(f"n_{i}") for i in range(len(holdouts))])
    counts = {(r["imp"], r["label"]): r for r in sizes.collect()}  # two rows an imputation

    def weights(i: int, imp: int):
        ones, zeros = (counts[imp, label][f"n_{i}"] if (imp, label) in counts else 0 for label in (1.0, 0.0))
        half = 0.5 * (ones + zeros)
        return F.when(F.col("label") == 1.0, half / max(ones, 1)).otherwise(half / max(zeros, 1))

    return rows, weights


def _stored_fits(spark, path: str | None) -> dict[tuple, float | None]:
    if path is None:
        return {}
    try:
        found = spark.read.schema(_FIT_SCHEMA).parquet(path).collect()  # one row a fit
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {tuple(r[k] for k in _FIT_KEYS): r["value"] for r in found}
