"""Fitted models. SQL cannot express the fits; it checks what they must satisfy (the `_contract` queries and the score equations)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnkit.functions import censoring as C
from tarnkit.functions.dates import iso_week
from tarnkit.models import bootstrap, draws, forest, holdout, impute
from tarnkit.operators.joins import lookup_join, stack
from tarnkit.operators.quantiles import group_quantiles
from tarnkit.operators.reshape import longer
from tarnkit.plans.bindings import SAMPLES, daily, samples, with_sql
from tarnkit.plans.registry import query
from tarnkit.session import cut

_GAPS = ["marker", "total"]
_COMPLETE = ["tn", "tp", "mean_temp"]
_FEATURES = ("marker", "total", "tn", "tp", "mean_temp")


def _training_table(spark: SparkSession, folder: str) -> DataFrame:
    """Samples with weather, a numeric row key, and the binary response."""
    weather = daily(spark, folder).select("region", "date_time", "mean_temp")
    table = lookup_join(samples(spark, folder), weather, {"sample_date": "date_time", "region": "region"}, "left", derived=True)
    return table.withColumns({
        "row_id": F.col("site") * 100000 + F.unix_date("sample_date"),
        "truth": C.detection_label("passive", "passive_lod"),
    })


def _completed(table: DataFrame, imputations: int = 2) -> DataFrame:
    """The completed stack, stored: what follows reads it several times, and its joins would run each time."""
    return cut(impute.impute_multiple(
        table, "row_id", _GAPS, _COMPLETE, ["site", "region", "sample_date", "truth"],
        imputations=imputations, sweeps=1, trees=10, depth=5,
    ))


@query()
def impute_multiple(spark: SparkSession, folder: str) -> DataFrame:
    return _completed(cut(_training_table(spark, folder))).select("imp", "row_id", "site", "sample_date", *_FEATURES, "truth")


@query()
def imputation_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Quantiles of each variable before and after imputation, per region."""
    table = cut(_training_table(spark, folder))
    sources = {
        "original": table.select("region", *_GAPS),
        "imputed": _completed(table, 1).select("region", *_GAPS),
    }
    long = longer(stack(sources, "source"), ["source", "region"], _GAPS)
    return group_quantiles(long, ["source", "region", "name"], "value", {"q25": 0.25, "median": 0.5, "q75": 0.75})


def _forests(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    table = _completed(cut(_training_table(spark, folder)), 1)
    holdouts = [holdout.Holdout("hold_nb", "region", "nb"), holdout.Holdout("hold_ns", "region", "ns")]
    spec = forest.ForestSpec("truth", _FEATURES, trees=20, mtry=2, min_n=5, max_depth=6)
    return forest.run_holdouts(table, spec, holdouts, [1], "row_id", at_once=2)


@query()
def holdout_forest(spark: SparkSession, folder: str) -> DataFrame:
    return _forests(spark, folder)[0]


@query()
def forest_importance(spark: SparkSession, folder: str) -> DataFrame:
    return _forests(spark, folder)[1]


@query()
def tuning_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Average accuracy over folds of a small parameter grid."""
    spec = forest.ForestSpec("truth", _FEATURES, trees=5, max_depth=4)
    table = _training_table(spark, folder).withColumn("imp", F.lit(1))
    table = table.withColumns({c: F.coalesce(F.col(c), F.col(f"{c}_lod")) for c in _GAPS})
    _, metrics = forest.tune_forest(table, spec, [1], "row_id", grid=[(1, 5), (3, 5)], folds=2, repeats=1)
    return holdout.mean_metrics(metrics)


_REPLICATES = 100


def _model_table(spark: SparkSession, folder: str) -> DataFrame:
    """Samples as three years of the sites, which the single year of the events does not give."""
    return _training_table(spark, folder).withColumns({
        "location": F.col("site").cast("string"),
        "year": F.year("sample_date") - F.col("site") % 3,
        "week": iso_week("sample_date").cast("double"),
        "log_tn": C.log10_offset("tn", 0.01),
    })


def _fitted(table: DataFrame) -> bootstrap.Coefficients:
    return bootstrap.bootstrap_coefficients(
        table, "row_id", F.col("truth") == "detected", "location", "year", "week", "log_tn", _REPLICATES)


_FITTED_SITES = "fitted AS (SELECT DISTINCT site, CAST(2024 - site % 3 AS VARCHAR) AS year FROM samples WHERE passive IS NOT NULL)"
_DRAW_NUMBERS = f"numbers AS (SELECT CAST(range AS INT) AS draw FROM range(1, {_REPLICATES + 1}))"


@query(with_sql(SAMPLES, _FITTED_SITES, _DRAW_NUMBERS, """SELECT draw, kind, name, CAST(0 AS DOUBLE) AS score FROM numbers CROSS JOIN (
  SELECT kind, CAST(site AS VARCHAR) AS name FROM fitted CROSS JOIN (VALUES ('location'), ('location_slope')) AS kinds(kind)
  UNION ALL SELECT DISTINCT 'year', year FROM fitted
  UNION ALL SELECT 'shared', name FROM (VALUES ('intercept'), ('slope'), ('sin1'), ('cos1'), ('sin2'), ('cos2')) AS terms(name))"""))
def bootstrap_coefficients(spark: SparkSession, folder: str) -> DataFrame:
    """Score equations of every replicate and term at the fitted coefficients: all are zero."""
    table = cut(_model_table(spark, folder))
    scores = bootstrap.score_equations(
        table, _fitted(table), "row_id", F.col("truth") == "detected", "location", "year", "week", "log_tn")
    return scores.withColumn("score", F.round("score", 6) + F.lit(0.0))


def _draws(spark: SparkSession, folder: str) -> DataFrame:
    table = cut(_model_table(spark, folder))
    grid = draws.prediction_grid(table, ["location", "year"], {"week": ("week", 3), "log_tn": ("log_tn", 10)})
    return bootstrap.draws_of(_fitted(table), grid, "location", "year", "week", "log_tn")


@query()
def detection_model_draws(spark: SparkSession, folder: str) -> DataFrame:
    return _draws(spark, folder)


_SITES = "sites AS (SELECT site, CAST(2024 - site % 3 AS INT) AS year, COUNT(passive) > 0 AS known FROM samples GROUP BY 1, 2)"


@query(with_sql(SAMPLES, _SITES, f"""SELECT CAST(site AS VARCHAR) AS location, year, CAST({30 * _REPLICATES} AS BIGINT) AS cells,
  CAST(CASE WHEN known THEN {30 * _REPLICATES} ELSE 0 END AS BIGINT) AS probabilities FROM sites"""))
def draws_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of each location and year, and those whose value is a probability: all, unless the location has no known outcome."""
    return _draws(spark, folder).groupBy("location", "year").agg(
        F.count("*").alias("cells"), F.count(F.when((F.col("p") > 0) & (F.col("p") < 1), 1)).alias("probabilities"))


_ROW_ID = "site * 100000 + (sample_date - DATE '1970-01-01')"


@query(with_sql(SAMPLES, f"""SELECT CAST(imp AS INT) AS imp, {_ROW_ID} AS row_id, TRUE AS kept, TRUE AS from_donors
FROM samples CROSS JOIN (SELECT range AS imp FROM range(1, 3))"""))
def impute_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Each completed row keeps what was observed, and its other values are observed ones of other rows."""
    table = cut(_training_table(spark, folder))
    completed = _completed(table)
    before = table.select("row_id", *[F.col(c).alias(f"_{c}") for c in _GAPS])
    joined = completed.join(before, "row_id")
    for c in _GAPS:
        seen = before.select(F.col(f"_{c}").alias(c)).dropna().distinct().withColumn(f"_seen_{c}", F.lit(True))
        joined = joined.join(seen, c, "left")
    kept, donors = F.lit(True), F.lit(True)
    for c in _GAPS:
        kept = kept & F.coalesce(F.col(f"_{c}") == F.col(c), F.lit(True))
        donors = donors & F.coalesce(F.col(f"_seen_{c}"), F.lit(False))
    return joined.select("imp", "row_id", kept.alias("kept"), donors.alias("from_donors"))


@query(with_sql(SAMPLES, f"""SELECT 'hold_' || region AS model, CAST(1 AS INT) AS imp, {_ROW_ID} AS row_id,
  CASE WHEN passive > passive_lod THEN 'detected' ELSE 'not_detected' END AS truth, TRUE AS in_range FROM samples WHERE passive IS NOT NULL"""))
def holdout_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Every held-out row with a known response is predicted once, by a probability."""
    in_range = (F.col("score") >= 0) & (F.col("score") <= 1)
    return _forests(spark, folder)[0].select("model", "imp", "row_id", "truth", in_range.alias("in_range"))


@query(f"""SELECT model, CAST(1 AS INT) AS imp, CAST({len(_FEATURES)} AS BIGINT) AS variables, CAST(1 AS DOUBLE) AS total, TRUE AS none_negative
FROM (VALUES ('hold_nb'), ('hold_ns')) AS models(model)""")
def importance_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Importances of each fit: one a feature, none negative, in sum one."""
    return _forests(spark, folder)[1].groupBy("model", "imp").agg(
        F.countDistinct("variable").alias("variables"), F.sum("importance").alias("total"), F.every(F.col("importance") >= 0).alias("none_negative"))


@query("""SELECT CAST(mtry AS INT) AS mtry, CAST(5 AS INT) AS min_n, 'accuracy' AS metric, TRUE AS in_range FROM (VALUES (1), (3)) AS grid(mtry)""")
def tuning_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of the grid has a mean accuracy between zero and one."""
    return tuning_metrics(spark, folder).select("mtry", "min_n", "metric", F.col("avg").between(0, 1).alias("in_range"))


_GRID = [(1, 5), (3, 5)]


@query(with_sql(SAMPLES, f"""SELECT 'hold_' || region AS model, CAST(1 AS INT) AS imp, {_ROW_ID} AS row_id,
  CASE WHEN passive > passive_lod THEN 'detected' ELSE 'not_detected' END AS truth, TRUE AS in_range, TRUE AS from_grid
FROM samples WHERE passive IS NOT NULL"""))
def tuned_holdout(spark: SparkSession, folder: str) -> DataFrame:
    """Hold-outs whose forests have the parameters that did best on their own training rows."""
    table = _completed(cut(_training_table(spark, folder)), 1)
    splits = [holdout.Holdout(f"hold_{x}", "region", x) for x in ("nb", "ns")]
    spec = forest.ForestSpec("truth", _FEATURES, trees=5, max_depth=4)
    chosen, _ = forest.tune_holdouts(table, spec, splits, [1], "row_id", grid=_GRID, folds=2, repeats=1)
    predictions, _ = forest.run_holdouts(table, spec, splits, [1], "row_id", chosen=chosen)
    from_grid = all(pair in _GRID for pair in chosen.values())
    in_range = (F.col("score") >= 0) & (F.col("score") <= 1)
    return predictions.select("model", "imp", "row_id", "truth", in_range.alias("in_range"), F.lit(from_grid).alias("from_grid"))
