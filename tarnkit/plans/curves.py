"""Probability draws: grids, thresholds, calibration, predictive checks; comparison of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnkit.functions.dates import week_to_date
from tarnkit.models import compare
from tarnkit.models import draws as D
from tarnkit.plans.bindings import (
    DRAWS, POINTWISE, SCORES, draws, pointwise, scores, with_sql,
)
from tarnkit.plans.registry import query
from tarnkit.sources.tables import read_table


@query("""SELECT location, year, ROUND(lo_w + w * (hi_w - lo_w) / 9, 6) AS week, ROUND(lo_x + x * (hi_x - lo_x) / 19, 6) AS level
FROM (SELECT DISTINCT l_suppkey AS location, CAST(year(l_shipdate) AS INT) AS year FROM lineitem)
CROSS JOIN (SELECT MIN(month(l_shipdate)) AS lo_w, MAX(month(l_shipdate)) AS hi_w, MIN(l_tax) AS lo_x, MAX(l_tax) AS hi_x FROM lineitem)
CROSS JOIN (SELECT range AS w FROM range(10)) CROSS JOIN (SELECT range AS x FROM range(20))""")
def prediction_grid(spark: SparkSession, folder: str) -> DataFrame:
    lines = read_table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("location"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), "l_tax"
    )
    return D.prediction_grid(lines, ["location", "year"], {"week": ("month", 10), "level": ("l_tax", 20)})


@query(with_sql(DRAWS, "SELECT location, year, week, x, ROUND(AVG(p), 6) AS mean_p FROM draws GROUP BY 1, 2, 3, 4"))
def mean_draws(spark: SparkSession, folder: str) -> DataFrame:
    return D.mean_draws(draws(spark, folder))


_THRESHOLDS = """merged AS (SELECT location, year, week, draw, p, AVG(x) AS m FROM draws GROUP BY 1, 2, 3, 4, 5),
steps AS (SELECT *, LEAD(p) OVER w AS np, LEAD(m) OVER w AS nm, COUNT(*) OVER c AS points, MIN(p) OVER c AS lo, MAX(p) OVER c AS hi,
    FIRST_VALUE(m) OVER a AS at_lo, LAST_VALUE(m) OVER a AS at_hi
  FROM merged WINDOW w AS (PARTITION BY location, year, week, draw ORDER BY p), c AS (PARTITION BY location, year, week, draw),
    a AS (PARTITION BY location, year, week, draw ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
thresholds AS (SELECT location, year, week, draw, t.probability, CASE WHEN MAX(points) = 1 THEN NULL WHEN MAX(lo) > t.probability THEN MAX(at_lo)
    WHEN MAX(hi) < t.probability THEN MAX(at_hi) ELSE MAX(CASE WHEN p <= t.probability AND np >= t.probability THEN m + (t.probability - p) * (nm - m) / (np - p) END) END AS threshold
  FROM steps CROSS JOIN (SELECT UNNEST([0.5::DOUBLE, 0.75, 0.95]) AS probability) t GROUP BY 1, 2, 3, 4, 5)"""


@query(with_sql(DRAWS, _THRESHOLDS, "SELECT location, year, week, draw, probability, ROUND(threshold, 6) AS threshold FROM thresholds"))
def threshold_draws(spark: SparkSession, folder: str) -> DataFrame:
    return D.crossing_points(draws(spark, folder))


@query(with_sql(DRAWS, _THRESHOLDS, """SELECT location, year, week, probability, ROUND(MEDIAN(threshold), 6) AS median, ROUND(QUANTILE_CONT(threshold, 0.25), 6) AS q25,
  ROUND(QUANTILE_CONT(threshold, 0.75), 6) AS q75, CAST(DATE '2023-01-01' + CAST(7 * week AS INT) AS DATE) AS date FROM thresholds GROUP BY 1, 2, 3, 4"""))
def threshold_summary(spark: SparkSession, folder: str) -> DataFrame:
    return D.threshold_summary(D.crossing_points(draws(spark, folder)))


@query("""SELECT o_orderkey, CAST(DATE '2023-01-01' + CAST(FLOOR(7 * (o_totalprice / 10000)) AS INT) AS DATE) AS date FROM orders""")
def week_dates(spark: SparkSession, folder: str) -> DataFrame:
    week = F.col("o_totalprice") / 10000
    return read_table(spark, folder, "orders").select("o_orderkey", week_to_date(week).alias("date"))


@query(with_sql(SCORES, """SELECT model, CASE WHEN points > 0 AND points <= 60 THEN CAST(CEIL(points / 6.0) AS INT) END AS bin, COUNT(*) AS n,
  ROUND(AVG(CASE WHEN truth = 'detected' THEN 1.0 ELSE 0 END), 6) AS observed, ROUND(AVG(score), 6) AS predicted FROM scores GROUP BY 1, 2"""))
def calibration(spark: SparkSession, folder: str) -> DataFrame:
    return D.calibration(scores(spark, folder), "score", F.col("truth") == "detected", ["model"])


_REPLICATES = """replicates AS (SELECT model, imp, CASE WHEN truth = 'detected' THEN 1.0::DOUBLE ELSE 0 END AS y,
  CASE WHEN (row_id * 31 + imp * 17) % 60 < points THEN 1.0::DOUBLE ELSE 0 END AS rep FROM scores),
per_draw AS (SELECT model, imp, COUNT(*) AS n, AVG(y) AS om, STDDEV_SAMP(y) AS os, SUM(y) AS oc, AVG(rep) AS m, STDDEV_SAMP(rep) AS s, SUM(rep) AS c FROM replicates GROUP BY 1, 2)"""


@query(with_sql(SCORES, _REPLICATES, "SELECT model, MAX(n) AS n, ROUND(MAX(om), 6) AS observed_mean, ROUND(MAX(os), 6) AS observed_sd, MAX(oc) AS observed_count, " + ", ".join(
    f"ROUND(QUANTILE_CONT({c}, {p}), 6) AS {stat}_{end}" for stat, c in (("mean", "m"), ("sd", "s"), ("count", "c"))
    for end, p in (("low", .05), ("median", .5), ("high", .95))) + " FROM per_draw GROUP BY 1"))
def grouped_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Imputations serve as draws; a replicate is a deterministic coin with the predicted probability."""
    coin = (F.col("row_id") * 31 + F.col("imp") * 17) % 60 < F.col("points")
    table = scores(spark, folder).select(
        "model", "imp", (F.col("truth") == "detected").cast("int").alias("y"), coin.cast("int").alias("rep")
    )
    return D.grouped_checks(table, ["model"], "imp", "y", "rep")


@query(with_sql(SCORES, """SELECT model, row_id, ROUND(MAX(CASE WHEN truth = 'detected' THEN 1.0::DOUBLE ELSE 0 END), 6) AS observed, ROUND(AVG(score), 6) AS fitted,
  ROUND(MAX(CASE WHEN truth = 'detected' THEN 1 ELSE 0 END) - AVG(score), 6) AS residual FROM scores GROUP BY 1, 2"""))
def residual_table(spark: SparkSession, folder: str) -> DataFrame:
    return D.residuals(scores(spark, folder), ["model", "row_id"], F.col("truth") == "detected", "score")


_COMPARED = """totals AS (SELECT model, SUM(lpd) AS elpd FROM pointwise GROUP BY 1),
best AS (SELECT model FROM totals ORDER BY elpd DESC, model DESC LIMIT 1),
paired AS (SELECT p.model, p.lpd, p.lpd - b.lpd AS diff, p.khat FROM pointwise p JOIN pointwise b ON p.obs = b.obs AND b.model = (SELECT model FROM best)),
compared AS (SELECT model, COUNT(*) AS n_obs, SUM(lpd) AS elpd_loo, SQRT(COUNT(*)) * STDDEV_SAMP(lpd) AS se_elpd_loo, SUM(diff) AS elpd_diff,
  SQRT(COUNT(*)) * STDDEV_SAMP(diff) AS se_diff, -2 * SUM(lpd) AS looic, 2 * SQRT(COUNT(*)) * STDDEV_SAMP(lpd) AS se_looic,
  -2 * SUM(lpd) + 2 * (SELECT MAX(elpd) FROM totals) AS delta_looic,
  COUNT(*) FILTER (WHERE khat > 0.7) AS n_khat_gt_07, COUNT(*) FILTER (WHERE khat > 1) AS n_khat_gt_1 FROM paired GROUP BY 1)"""

_LOO = ["elpd_loo", "se_elpd_loo", "elpd_diff", "se_diff", "looic", "se_looic", "delta_looic"]


@query(with_sql(POINTWISE, _COMPARED, "SELECT model, n_obs, " + ", ".join(f"ROUND({c}, 6) AS {c}" for c in _LOO) + " FROM compared"))
def loo_compare(spark: SparkSession, folder: str) -> DataFrame:
    return compare.compare_models(pointwise(spark, folder))


@query(with_sql(POINTWISE, _COMPARED, "SELECT model, n_obs, n_khat_gt_07, n_khat_gt_1, " + ", ".join(f"ROUND({c}, 3) AS {c}" for c in _LOO) + " FROM compared"))
def khat_counts(spark: SparkSession, folder: str) -> DataFrame:
    return compare.comparison_table(pointwise(spark, folder), digits=3)
