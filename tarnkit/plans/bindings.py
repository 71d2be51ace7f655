"""The test tables seen as monitoring data, once as DataFrames and once as SQL for the check.

* ``samples``: one row per (site, sample_date) with two toxin methods, a substitute method and two genes, each
  missing on many days, plus detection limits that differ by site, and two nutrients;
* ``daily``: weather per (region, date); ``stations``: readings per (station, date, parameter);
* ``scores``: predicted scores and truth per (model, imp, row); ``importance``: per (model, imp, variable);
* ``draws``: probability curves per (location, year, week, draw); ``pointwise``: log densities per (model, obs).

All of them are derived from whole tables and grow with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnkit.functions.semantics import if_else3
from tarnkit.models.draws import POINTS_AT_ONCE
from tarnkit.operators.joins import expand_grid
from tarnkit.session import cut, shuffle_pieces
from tarnkit.sources.tables import read_table


def samples(spark: SparkSession, folder: str) -> DataFrame:
    def first_of(kind: str):
        chosen = F.col("event_type") == kind
        return F.min_by(F.when(chosen, F.col("value")), F.when(chosen, F.col("event_id")))

    kinds = {"grab": "view", "passive": "purchase", "spe": "signup", "marker": "error", "total": "click"}
    site = F.col("site")
    per_day = (
        read_table(spark, folder, "events")
        .groupBy(F.col("user_id").alias("site"), F.col("ts").cast("date").alias("sample_date"))
        .agg(
            *[first_of(kind).alias(name) for name, kind in kinds.items()],
            F.max("value").alias("tn"),
            F.min("value").alias("tp"),
        )
    )
    return per_day.withColumns(
        {
            "grab_lod": (40 + site % 12).cast("double"),
            "passive_lod": (25 + 2 * (site % 12)).cast("double"),
            "spe_lod": F.lit(30.0),
            "marker_lod": (10 + site % 5).cast("double"),
            "total_lod": F.lit(15.0),
            "region": F.when(site % 2 == 0, "nb").otherwise("ns"),
        }
    )


SAMPLES = """samples AS (
SELECT *, CAST(40 + site % 12 AS DOUBLE) AS grab_lod, CAST(25 + 2 * (site % 12) AS DOUBLE) AS passive_lod,
  CAST(30 AS DOUBLE) AS spe_lod, CAST(10 + site % 5 AS DOUBLE) AS marker_lod, CAST(15 AS DOUBLE) AS total_lod,
  CASE WHEN site % 2 = 0 THEN 'nb' ELSE 'ns' END AS region
FROM (
  SELECT user_id AS site, CAST(ts AS DATE) AS sample_date,
    MIN_BY(value, event_id) FILTER (WHERE event_type = 'view') AS grab,
    MIN_BY(value, event_id) FILTER (WHERE event_type = 'purchase') AS passive,
    MIN_BY(value, event_id) FILTER (WHERE event_type = 'signup') AS spe,
    MIN_BY(value, event_id) FILTER (WHERE event_type = 'error') AS marker,
    MIN_BY(value, event_id) FILTER (WHERE event_type = 'click') AS total,
    MAX(value) AS tn, MIN(value) AS tp
  FROM events GROUP BY 1, 2))"""


def daily(spark: SparkSession, folder: str) -> DataFrame:
    rain = F.when((F.col("event_type") == "click") & (F.col("value") > 60), F.col("value"))
    return (
        read_table(spark, folder, "events")
        .groupBy(
            F.when(F.col("user_id") % 2 == 0, "nb").otherwise("ns").alias("region"),
            F.col("ts").cast("date").alias("date_time"),
        )
        .agg(
            F.sum(rain).alias("total_precip"), F.avg("value").alias("mean_temp"), F.max("value").alias("max_temp")
        )
    )


DAILY = """daily AS (
SELECT CASE WHEN user_id % 2 = 0 THEN 'nb' ELSE 'ns' END AS region, CAST(ts AS DATE) AS date_time,
  SUM(value) FILTER (WHERE event_type = 'click' AND value > 60) AS total_precip,
  AVG(value) AS mean_temp, MAX(value) AS max_temp
FROM events GROUP BY 1, 2)"""


def stations(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "events").select(
        F.col("user_id").alias("station"), F.col("ts").cast("date").alias("date_time"),
        F.col("event_type").alias("param"), "value",
    )


STATIONS = """stations AS (
SELECT user_id AS station, CAST(ts AS DATE) AS date_time, event_type AS param, value FROM events)"""


def scores(spark: SparkSession, folder: str) -> DataFrame:
    labels = read_table(spark, folder, "labels").select("doc_id", "quality")
    documents = read_table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    rows = labels.join(documents, "doc_id")
    language = F.when(F.col("lang") == "en", "2024").otherwise(F.col("lang"))
    models = F.array(F.concat(F.lit("hold_"), language), F.when(F.col("quality") == 1, "hold_single"))
    rows = expand_grid(rows, model=F.filter(models, lambda m: m.isNotNull()))
    rows = expand_grid(rows, imp=F.sequence(F.lit(1), F.lit(5)))
    points = F.col("n_chars") % 40 + F.col("quality") * 8 + (F.col("doc_id") * 7 + F.col("imp") * 13) % 11
    return rows.select(
        "model", "imp", F.col("doc_id").alias("row_id"),
        if_else3(F.col("quality") == 1, F.lit("detected"), F.lit("not_detected")).alias("truth"),
        points.alias("points"), (points.cast("double") / 60).alias("score"),
    )


SCORES = """scores AS (
SELECT m.model, i.imp, b.doc_id AS row_id, CASE WHEN quality = 1 THEN 'detected' ELSE 'not_detected' END AS truth,
  n_chars % 40 + quality * 8 + (b.doc_id * 7 + i.imp * 13) % 11 AS points,
  CAST(n_chars % 40 + quality * 8 + (b.doc_id * 7 + i.imp * 13) % 11 AS DOUBLE) / 60 AS score
FROM (SELECT l.doc_id, l.quality, d.lang, d.n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id) b
JOIN (SELECT doc_id, 'hold_' || CASE WHEN lang = 'en' THEN '2024' ELSE lang END AS model FROM documents
      UNION ALL SELECT doc_id, 'hold_single' FROM labels WHERE quality = 1) m ON m.doc_id = b.doc_id
CROSS JOIN (SELECT CAST(range AS INT) AS imp FROM range(1, 6)) i)"""


def importance(spark: SparkSession, folder: str) -> DataFrame:
    line = F.col("l_linenumber")
    return (
        read_table(spark, folder, "lineitem")
        .groupBy(
            F.when(line == 7, "m_2024").otherwise(F.concat(F.lit("m_loc"), line.cast("string"))).alias("model"),
            F.quarter("l_shipdate").alias("imp"),
            F.concat(F.lit("v"), F.col("l_suppkey").cast("string")).alias("variable"),
        )
        .agg(F.sum("l_quantity").alias("importance"), F.sum(F.round(F.col("l_tax") * 100)).alias("other_importance"))
    )


IMPORTANCE = """importance AS (
SELECT CASE WHEN l_linenumber = 7 THEN 'm_2024' ELSE 'm_loc' || CAST(l_linenumber AS VARCHAR) END AS model,
  CAST(quarter(l_shipdate) AS INT) AS imp, 'v' || CAST(l_suppkey AS VARCHAR) AS variable,
  SUM(l_quantity) AS importance, SUM(ROUND(l_tax * 100)) AS other_importance
FROM lineitem GROUP BY 1, 2, 3)"""


def curve_cells(spark: SparkSession, folder: str) -> DataFrame:
    cells = (
        read_table(spark, folder, "lineitem")
        .groupBy(F.col("l_suppkey").alias("location"), F.year("l_shipdate").alias("year"))
        .agg((F.sum("l_quantity") / F.count(F.lit(1))).alias("level"))
    )
    return cells


def draws(spark: SparkSession, folder: str, n_draws: int = 5, n_x: int = 12, n_weeks: int = 4) -> DataFrame:
    cells = cut(curve_cells(spark, folder))
    tasks = max(shuffle_pieces(spark), -(-cells.count() * n_draws * n_x * n_weeks // POINTS_AT_ONCE))
    grid = expand_grid(
        cells.repartition(tasks, "location", "year"),
        week=F.sequence(F.lit(0), F.lit(n_weeks - 1)),
        draw=F.sequence(F.lit(0), F.lit(n_draws - 1)),
        i=F.sequence(F.lit(0), F.lit(n_x - 1)),
    )
    location, draw = F.col("location"), F.col("draw")
    slope = F.when((location + draw) % 11 == 0, 0.0).otherwise(0.4 + (draw * 3 + location) % 7 * 0.1)
    x = F.col("i").cast("double") / 2
    logit = F.lit(-3.0) + (F.col("level") - 25) * 0.1 + F.col("week") * 0.3 + draw * 0.1 + slope * x
    return grid.select(
        "location", "year", "week", "draw", x.alias("x"), (1 / (1 + F.exp(-logit))).alias("p")
    )


DRAWS = """draws AS (
SELECT location, year, week, draw, CAST(i AS DOUBLE) / 2 AS x,
  1 / (1 + EXP(-(-3.0::DOUBLE + (level - 25) * 0.1::DOUBLE + week * 0.3::DOUBLE + draw * 0.1::DOUBLE
    + CASE WHEN (location + draw) % 11 = 0 THEN 0::DOUBLE ELSE 0.4::DOUBLE + (draw * 3 + location) % 7 * 0.1::DOUBLE END
      * (CAST(i AS DOUBLE) / 2)))) AS p
FROM (SELECT l_suppkey AS location, CAST(year(l_shipdate) AS INT) AS year, SUM(l_quantity) / COUNT(*) AS level
      FROM lineitem GROUP BY 1, 2)
CROSS JOIN (SELECT CAST(range AS INT) AS week FROM range(4))
CROSS JOIN (SELECT CAST(range AS INT) AS draw FROM range(5))
CROSS JOIN (SELECT CAST(range AS INT) AS i FROM range(12)))"""


def pointwise(spark: SparkSession, folder: str) -> DataFrame:
    rows = expand_grid(read_table(spark, folder, "customer").select("c_custkey"), m=F.sequence(F.lit(0), F.lit(4)))
    key, m = F.col("c_custkey"), F.col("m")
    return rows.select(
        F.concat(F.lit("model_"), m.cast("string")).alias("model"), key.alias("obs"),
        (F.lit(-0.05) - ((key * 37 + m * 53) % 97).cast("double") / 100 - m * 0.02).alias("lpd"),
        (((key * 41 + m * 11) % 120).cast("double") / 100).alias("khat"),
    )


POINTWISE = """pointwise AS (
SELECT 'model_' || CAST(m AS VARCHAR) AS model, c_custkey AS obs,
  -0.05::DOUBLE - CAST((c_custkey * 37 + m * 53) % 97 AS DOUBLE) / 100 - m * 0.02::DOUBLE AS lpd,
  CAST((c_custkey * 41 + m * 11) % 120 AS DOUBLE) / 100 AS khat
FROM customer CROSS JOIN (SELECT range AS m FROM range(5)))"""


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def with_sql(*parts: str) -> str:
    """CTE parts followed by the final statement."""
    *ctes, statement = parts
    return f"WITH {', '.join(ctes)} {statement}" if ctes else statement
