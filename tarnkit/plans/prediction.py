"""Prediction tables: class weights, hold-out splits, tuning choice, ROC and importance summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnkit.models import holdout, importance, roc
from tarnkit.operators.joins import expand_grid
from tarnkit.plans.bindings import IMPORTANCE, SCORES, importance as importance_table, samples, SAMPLES, scores, with_sql
from tarnkit.plans.registry import query
from tarnkit.session import cut


@query(with_sql(SCORES, """SELECT model, imp, row_id, truth, ROUND(CASE WHEN COUNT(*) OVER t > 0 THEN 0.5 * COUNT(*) OVER f / COUNT(*) OVER t END, 6) AS weight
FROM scores WINDOW f AS (PARTITION BY model, imp), t AS (PARTITION BY model, imp, truth)"""))
def class_weights(spark: SparkSession, folder: str) -> DataFrame:
    table = scores(spark, folder).select("model", "imp", "row_id", "truth")
    return holdout.class_weights(table, "truth", ["model", "imp"])


_SPLITS = """targets AS (SELECT * FROM samples WHERE passive IS NOT NULL),
folds AS (SELECT DISTINCT region AS held_out, 'region' AS scheme FROM targets
          UNION SELECT DISTINCT CAST(day(sample_date) // 10 AS VARCHAR), 'decade' FROM targets)"""


@query(with_sql(SAMPLES, _SPLITS, """SELECT 'hold_' || f.held_out AS model,
  COUNT(*) FILTER (WHERE CASE f.scheme WHEN 'region' THEN region ELSE CAST(day(sample_date) // 10 AS VARCHAR) END <> f.held_out) AS n_train,
  COUNT(*) FILTER (WHERE CASE f.scheme WHEN 'region' THEN region ELSE CAST(day(sample_date) // 10 AS VARCHAR) END = f.held_out) AS n_test
FROM targets CROSS JOIN folds f GROUP BY 1"""))
def holdout_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of every hold-out split, by region and by ten-day block, in one pass."""
    table = samples(spark, folder).filter(F.col("passive").isNotNull())
    table = table.withColumn("decade", F.floor(F.dayofmonth("sample_date") / 10).cast("string"))
    return holdout.split_sizes(table, ["region", "decade"])


_GRID = """metrics AS (SELECT imp, mtry, min_n, COUNT(*) FILTER (WHERE ((points + mtry + min_n) % 60 >= 24) = (truth = 'detected')) / COUNT(*)::DOUBLE AS accuracy
FROM scores CROSS JOIN (SELECT CAST(range AS INT) AS mtry FROM range(2, 7)) CROSS JOIN (SELECT CAST(range * 10 AS INT) AS min_n FROM range(1, 5))
GROUP BY 1, 2, 3)"""


@query(with_sql(SCORES, _GRID, """SELECT mtry, min_n, ROUND(avg, 6) AS avg FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY ROUND(avg, 9) DESC, mtry, min_n) AS r
FROM (SELECT mtry, min_n, AVG(accuracy) AS avg FROM metrics GROUP BY 1, 2)) WHERE r = 1"""))
def best_hyperparameters(spark: SparkSession, folder: str) -> DataFrame:
    """Selection from a table of per-imputation accuracies over a 5 x 4 grid."""
    table = expand_grid(scores(spark, folder), mtry=[2, 3, 4, 5, 6], min_n=[10, 20, 30, 40])
    called = (F.col("points") + F.col("mtry") + F.col("min_n")) % 60 >= 24
    right = (called == (F.col("truth") == "detected")).cast("int")
    metrics = table.groupBy("imp", "mtry", "min_n").agg(F.avg(right).alias("value")).withColumn("metric", F.lit("accuracy"))
    return holdout.best_parameters(metrics, "accuracy").select("mtry", "min_n", "avg")


_RANKED_SCORES = """r AS (SELECT model, imp, truth, RANK() OVER (PARTITION BY model, imp ORDER BY score)
  + (COUNT(*) OVER (PARTITION BY model, imp, score) - 1) / 2.0::DOUBLE AS rk FROM scores),
aucs AS (SELECT model, imp, CASE WHEN np > 0 AND nn > 0 THEN (rp - np * (np + 1) / 2) / (np * nn) END AS auc FROM (
  SELECT model, imp, SUM(rk) FILTER (WHERE truth = 'detected')::DOUBLE AS rp, COUNT(*) FILTER (WHERE truth = 'detected')::DOUBLE AS np,
    COUNT(*) FILTER (WHERE truth <> 'detected')::DOUBLE AS nn FROM r GROUP BY 1, 2))"""


@query(with_sql(SCORES, _RANKED_SCORES, "SELECT model, imp, ROUND(auc, 6) AS auc FROM aucs"))
def auc_by_model(spark: SparkSession, folder: str) -> DataFrame:
    return roc.auc(cut(scores(spark, folder)))


_CURVE = """counts AS (SELECT model, imp, score, COUNT(*) FILTER (WHERE truth = 'detected') AS pos,
    COUNT(*) FILTER (WHERE truth <> 'detected') AS neg FROM scores GROUP BY 1, 2, 3),
steps AS (SELECT model, imp, score, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp,
    SUM(pos) OVER (PARTITION BY model, imp) AS np, SUM(neg) OVER (PARTITION BY model, imp) AS nn
  FROM counts WINDOW w AS (PARTITION BY model, imp ORDER BY score DESC)),
curve AS (SELECT model, imp, score AS threshold, CASE WHEN np > 0 THEN tp / np::DOUBLE END AS sensitivity,
    CASE WHEN nn > 0 THEN 1 - fp / nn::DOUBLE END AS specificity FROM steps
  UNION ALL SELECT DISTINCT model, imp, '-inf'::DOUBLE, CASE WHEN np > 0 THEN 1 END, CASE WHEN nn > 0 THEN 0 END FROM steps
  UNION ALL SELECT DISTINCT model, imp, 'inf'::DOUBLE, CASE WHEN np > 0 THEN 0 END, CASE WHEN nn > 0 THEN 1 END FROM steps)"""


@query(with_sql(SCORES, _CURVE, """SELECT model, imp, ROUND(threshold, 6) AS threshold, ROUND(sensitivity, 6) AS sensitivity,
  ROUND(specificity, 6) AS specificity FROM curve WHERE threshold > 0"""))
def roc_points(spark: SparkSession, folder: str) -> DataFrame:
    return roc.roc_curve(cut(scores(spark, folder)), min_threshold=0.0)


_LOOKUP = """lookup AS (SELECT model, imp, row_id, CASE WHEN np > 0 THEN tp / np END AS sensitivity,
  CASE WHEN nn > 0 THEN 1 - fp / nn END AS specificity, CASE WHEN nn > 0 THEN fp / nn END AS fpr FROM (
  SELECT model, imp, row_id, SUM(CASE WHEN truth = 'detected' THEN 1.0::DOUBLE ELSE 0 END) OVER w AS tp,
    SUM(CASE WHEN truth = 'detected' THEN 0::DOUBLE ELSE 1 END) OVER w AS fp,
    SUM(CASE WHEN truth = 'detected' THEN 1.0::DOUBLE ELSE 0 END) OVER f AS np,
    SUM(CASE WHEN truth = 'detected' THEN 0::DOUBLE ELSE 1 END) OVER f AS nn
  FROM scores WINDOW w AS (PARTITION BY model, imp ORDER BY score DESC, row_id ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY model, imp)))"""


@query(with_sql(SCORES, _LOOKUP, """SELECT model, imp, row_id, ROUND(sensitivity, 6) AS sensitivity,
  ROUND(specificity, 6) AS specificity, ROUND(fpr, 6) AS fpr FROM lookup"""))
def sens_spec_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return roc.sens_spec_lookup(cut(scores(spark, folder)))


_LEVELS = [0.25, 0.5, 0.75, 0.9]


@query(with_sql(SCORES, _LOOKUP, " UNION ALL ".join(
    f"SELECT model, imp, {s}::DOUBLE AS specificity, ROUND(MAX(sensitivity), 6) AS sensitivity, ROUND(1 - {s}::DOUBLE, 6) AS fpr "
    f"FROM lookup WHERE specificity >= {s}::DOUBLE GROUP BY 1, 2" for s in _LEVELS)))
def sens_at_spec(spark: SparkSession, folder: str) -> DataFrame:
    return roc.sensitivity_at(roc.sens_spec_lookup(cut(scores(spark, folder))), ["model", "imp"], _LEVELS)


@query(with_sql(SCORES, _RANKED_SCORES, """SELECT model, ROUND(QUANTILE_CONT(auc, 0.025), 3) AS min, ROUND(MEDIAN(auc), 3) AS auc,
  ROUND(QUANTILE_CONT(auc, 0.975), 3) AS max, CASE model WHEN 'hold_2024' THEN 'Year 2024' ELSE model END AS location FROM aucs GROUP BY model"""))
def auc_summary(spark: SparkSession, folder: str) -> DataFrame:
    return roc.auc_summary(roc.auc(cut(scores(spark, folder))), labels={"hold_2024": "Year 2024"})


_BANDS = """med AS (SELECT model, imp, specificity, MEDIAN(sensitivity) AS m FROM curve
  WHERE specificity IS NOT NULL AND sensitivity IS NOT NULL GROUP BY 1, 2, 3),
bands AS (SELECT model, specificity, QUANTILE_CONT(m, 0.25) AS l, QUANTILE_CONT(m, 0.75) AS u, MEDIAN(m) AS s FROM med GROUP BY 1, 2)"""


@query(with_sql(SCORES, _CURVE, _BANDS, """SELECT model, ROUND(specificity, 6) AS specificity, ROUND(MIN(l) OVER w, 6) AS lower, ROUND(MIN(u) OVER w, 6) AS upper, ROUND(MIN(s) OVER w, 6) AS sensitivity,
  CASE WHEN model LIKE '%2024' THEN 'Tested on 2024' ELSE 'Tested on Location' END AS model_type
FROM bands WINDOW w AS (PARTITION BY model ORDER BY specificity ROWS UNBOUNDED PRECEDING)"""))
def roc_bands(spark: SparkSession, folder: str) -> DataFrame:
    return roc.roc_bands(roc.roc_curve(cut(scores(spark, folder))))


@query(with_sql(SCORES, """SELECT model, imp, COUNT(*) AS n, ROUND(AVG(CAST((score >= 0.4) = (truth = 'detected') AS INT)), 6) AS accuracy,
  ROUND(AVG(CAST(score >= 0.4 AS INT)) FILTER (WHERE truth = 'detected'), 6) AS sensitivity,
  ROUND(AVG(CAST(score < 0.4 AS INT)) FILTER (WHERE truth <> 'detected'), 6) AS specificity,
  ROUND(AVG(POWER(score - CAST(truth = 'detected' AS INT), 2)), 6) AS brier FROM scores GROUP BY 1, 2"""))
def accuracy_table(spark: SparkSession, folder: str) -> DataFrame:
    return roc.accuracy_table(scores(spark, folder), threshold=0.4)


def _summary_sql(column: str, name: str) -> str:
    return f"""{name} AS (SELECT CASE WHEN model LIKE '%2024' THEN 'Tested on 2024' ELSE 'Tested on Location' END AS model_type, variable,
  MEDIAN(rel) AS avg_importance, QUANTILE_CONT(rel, 0.25) AS lower, QUANTILE_CONT(rel, 0.75) AS upper
FROM (SELECT model, variable, 100 * m / MAX(m) OVER (PARTITION BY model) AS rel FROM
  (SELECT model, variable, MEDIAN({column}) AS m FROM importance GROUP BY 1, 2)) GROUP BY 1, 2)"""


@query(with_sql(IMPORTANCE, _summary_sql("importance", "summary"), """SELECT model_type, variable, ROUND(avg_importance, 6) AS avg_importance,
  ROUND(lower, 6) AS lower, ROUND(upper, 6) AS upper FROM summary"""))
def importance_summary(spark: SparkSession, folder: str) -> DataFrame:
    return importance.importance_summary(importance_table(spark, folder))


_TOPS = """first AS (SELECT variable, avg_importance FROM (SELECT *, RANK() OVER (ORDER BY avg_importance DESC) AS r FROM one WHERE model_type <> 'Tested on 2024') WHERE r <= 15),
second AS (SELECT variable, avg_importance FROM (SELECT *, RANK() OVER (ORDER BY avg_importance DESC) AS r FROM two WHERE model_type <> 'Tested on 2024') WHERE r <= 15),
tops AS (SELECT 'grab' AS target, * FROM first UNION ALL SELECT 'passive', * FROM second)"""


@query(with_sql(IMPORTANCE, _summary_sql("importance", "one"), _summary_sql("other_importance", "two"), _TOPS, """SELECT target, variable, ROUND(avg_importance, 6) AS avg_importance,
  CASE WHEN variable IN (SELECT variable FROM first INTERSECT SELECT variable FROM second) THEN 'Shared predictor' ELSE 'Not shared' END AS shared FROM tops"""))
def top_predictors_shared(spark: SparkSession, folder: str) -> DataFrame:
    table = cut(importance_table(spark, folder))
    on_location = F.col("model_type") != "Tested on 2024"
    first = importance.importance_summary(table.drop("other_importance")).filter(on_location)
    second = importance.importance_summary(
        table.drop("importance").withColumnRenamed("other_importance", "importance")
    ).filter(on_location)
    return importance.top_shared(first, second, ("grab", "passive"))
