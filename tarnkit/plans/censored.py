"""Detection limits: flags, substitutions, detection rates and paired detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnkit.functions import censoring as C
from tarnkit.functions.dates import season_date
from tarnkit.functions.semantics import divide, in_order
from tarnkit.operators import detections, joins
from tarnkit.plans.bindings import SAMPLES, samples, with_sql
from tarnkit.plans.registry import query
from tarnkit.session import cut
from tarnkit.sources.tables import read_table


@query(with_sql(SAMPLES, """SELECT site, sample_date, grab > grab_lod AS grab_detected, grab >= grab_lod AS grab_at_least,
  CASE WHEN passive > passive_lod THEN 'detected' WHEN passive <= passive_lod THEN 'not_detected' END AS passive_label,
  CASE WHEN passive > passive_lod THEN 1 WHEN passive <= passive_lod THEN 0 END AS passive_binary FROM samples"""))
def detection_flags(spark: SparkSession, folder: str) -> DataFrame:
    return samples(spark, folder).select(
        "site", "sample_date",
        C.detected("grab", "grab_lod").alias("grab_detected"),
        C.detected("grab", "grab_lod", inclusive=True).alias("grab_at_least"),
        C.detection_label("passive", "passive_lod").alias("passive_label"),
        C.detection_label("passive", "passive_lod", 1, 0).alias("passive_binary"),
    )


@query(with_sql(SAMPLES, """SELECT site, sample_date,
  CASE WHEN marker IS NULL OR marker > marker_lod THEN 'none' ELSE 'left' END AS cens_marker,
  CASE WHEN total IS NULL OR total > total_lod THEN 'none' ELSE 'left' END AS cens_total,
  CASE WHEN marker IS NULL OR total IS NULL OR marker > marker_lod THEN 'none' ELSE 'left' END AS cens_ratio
FROM samples"""))
def censor_indicators(spark: SparkSession, folder: str) -> DataFrame:
    either_missing = F.col("marker").isNull() | F.col("total").isNull()
    return samples(spark, folder).select(
        "site", "sample_date",
        C.censoring("marker", "marker_lod").alias("cens_marker"),
        C.censoring("total", "total_lod").alias("cens_total"),
        F.when(either_missing, "none").otherwise(C.censoring("marker", "marker_lod")).alias("cens_ratio"),
    )


@query(with_sql(SAMPLES, """SELECT site, sample_date, GREATEST(marker, CASE WHEN marker IS NOT NULL THEN marker_lod END) AS at_limit,
  ROUND(CASE WHEN marker < marker_lod THEN 0 ELSE LOG10(marker) END, 6) AS zero_log,
  ROUND(CASE WHEN total IS NULL OR marker IS NULL THEN NULL WHEN total < total_lod THEN NULL
    ELSE CASE WHEN marker < marker_lod THEN 0 ELSE LOG10(marker) END / LOG10(total) END, 6) AS ratio
FROM samples"""))
def lod_substitution(spark: SparkSession, folder: str) -> DataFrame:
    table = in_order(
        samples(spark, folder),
        at_limit=C.at_least_limit("marker", "marker_lod"),
        zero_log=C.log10_or_zero("marker", "marker_lod"),
        _total=C.log10_or_zero("total", "total_lod"),
        ratio=divide("zero_log", F.when(F.col("_total") != 0, F.col("_total"))),
    )
    return table.select("site", "sample_date", "at_limit", "zero_log", "ratio")


@query(with_sql(SAMPLES, """SELECT site, sample_date, ROUND(LOG10(marker + 0.01), 6) AS log_marker,
  ROUND(LOG10(total + 0.1), 6) AS log_total FROM samples"""))
def log_offset(spark: SparkSession, folder: str) -> DataFrame:
    return samples(spark, folder).select(
        "site", "sample_date",
        C.log10_offset("marker", 0.01).alias("log_marker"), C.log10_offset("total", 0.1).alias("log_total"),
    )


@query(with_sql(SAMPLES, """SELECT site, COUNT(*) AS n, COUNT(*) FILTER (WHERE passive > passive_lod) AS n_detections,
  ROUND(AVG(CASE WHEN passive > passive_lod THEN 1.0 ELSE 0.0 END), 6) AS detection_rate,
  CAST(COUNT(*) FILTER (WHERE passive > passive_lod) AS VARCHAR) || ' / ' || CAST(COUNT(*) AS VARCHAR) AS label
FROM samples WHERE passive IS NOT NULL GROUP BY site"""))
def detection_summary(spark: SparkSession, folder: str) -> DataFrame:
    return detections.detection_summary(samples(spark, folder), ["site"], "passive", "passive_lod")


@query(with_sql(SAMPLES, """SELECT s.site, s.sample_date, s.grab, g.n_detections FROM samples s JOIN (
  SELECT site, COUNT(*) FILTER (WHERE grab > grab_lod) AS n_detections FROM samples GROUP BY 1
  HAVING COUNT(*) FILTER (WHERE grab > grab_lod) >= 3) g ON s.site = g.site"""))
def sites_with_detections(spark: SparkSession, folder: str) -> DataFrame:
    table = cut(samples(spark, folder))
    often = detections.groups_with_detections(table, ["site"], "grab", "grab_lod", at_least=3)
    return joins.lookup_join(table.select("site", "sample_date", "grab"), often, "site", "inner", derived=True)


@query(with_sql(SAMPLES, """SELECT site, year, COUNT(*) AS n_detects, CAST(COALESCE(SUM(same), 0) AS BIGINT) AS same_week,
  CAST(COALESCE(SUM(prev1), 0) AS BIGINT) AS prev_week, CAST(COALESCE(SUM(prev2), 0) AS BIGINT) AS two_weeks
FROM (SELECT site, year, event, same, LAG(same) OVER w AS prev1, LAG(same, 2) OVER w AS prev2
  FROM (SELECT site, CAST(year(sample_date) AS INT) AS year, sample_date, grab > grab_lod AS event,
          CAST(passive > passive_lod AS INT) AS same FROM samples)
  WINDOW w AS (PARTITION BY site, year ORDER BY sample_date))
WHERE event GROUP BY 1, 2"""))
def paired_detections(spark: SparkSession, folder: str) -> DataFrame:
    table = cut(samples(spark, folder)).withColumn("year", F.year("sample_date"))
    return detections.paired_detections(
        table, ["site", "year"], "sample_date", ("grab", "grab_lod"), ("passive", "passive_lod")
    )


@query("""SELECT o_orderkey, CASE WHEN NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29)
  THEN CAST('2022-' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') || '-' || lpad(CAST(
    CASE WHEN month(o_orderdate) = 2 THEN LEAST(day(o_orderdate), 28) ELSE day(o_orderdate) END AS VARCHAR), 2, '0') AS DATE)
  END AS season_date FROM orders""")
def season_align(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "orders").select("o_orderkey", season_date("o_orderdate", 2022).alias("season_date"))
