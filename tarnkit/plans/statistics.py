"""Rank tests, correlations, autocorrelation, scaling, order-dependent columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnkit.operators import correlation, ordering, quantiles, ranktests, reshape, scaling, summaries, timeseries
from tarnkit.operators.selectors import rename
from tarnkit.plans.bindings import DAILY, MEASURES, SAMPLES, daily, samples, with_sql
from tarnkit.plans.registry import query
from tarnkit.session import cut
from tarnkit.sources.tables import read_table
from tarnkit.study import predict

_LONG_LINES = "long AS (" + " UNION ALL ".join(
    f"SELECT l_linenumber AS location, '{c}' AS name, {c} AS value FROM lineitem" for c in MEASURES) + ")"

_RANK_SUMS = """ranked AS (SELECT name, location, value,
    RANK() OVER (PARTITION BY name ORDER BY value) + (COUNT(*) OVER (PARTITION BY name, value) - 1) / 2.0 AS r FROM long),
sums AS (SELECT name, location, COUNT(*)::DOUBLE AS n, SUM(r)::DOUBLE AS rs FROM ranked GROUP BY 1, 2),
tie AS (SELECT name, SUM(t * t * t - t)::DOUBLE AS ties FROM (SELECT name, value, COUNT(*)::DOUBLE AS t FROM long GROUP BY 1, 2) GROUP BY 1),
whole AS (SELECT name, SUM(n) AS nn, COUNT(*) AS k, SUM(rs * rs / n) AS sq FROM sums GROUP BY 1)"""


def _long_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = read_table(spark, folder, "lineitem").select(F.col("l_linenumber").alias("location"), *MEASURES)
    return reshape.longer(lines, ["location"], MEASURES)


@query(with_sql(_LONG_LINES, _RANK_SUMS, """SELECT name, ROUND(h, 6) AS statistic, CAST(k - 1 AS INT) AS df,
  ROUND(EXP(-h / 2) * (1 + h / 2 + h * h / 8), 6) AS p_value
FROM (SELECT name, k, (12.0 / (nn * (nn + 1)) * sq - 3 * (nn + 1)) / (1 - ties / (nn * nn * nn - nn)) AS h
      FROM whole JOIN tie USING (name))"""))
def kruskal_wallis(spark: SparkSession, folder: str) -> DataFrame:
    """Seven groups, so six degrees of freedom, for which the chi-squared tail has a closed form."""
    return ranktests.kruskal_wallis(_long_lines(spark, folder))


def _area(density: str, end: str, steps: int = 2000) -> str:
    """SQL for the integral of a density in x from 0 to `end`, by Simpson's rule."""
    inner = density.replace("x", f"({end} * i / {steps}.0)")
    weight = f"(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    return f"{end} / {3 * steps}.0 * list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * {inner}))"


_DUNN = """pairs AS (SELECT a.name, a.location AS group_1, b.location AS group_2,
  (a.rs / a.n - b.rs / b.n) / SQRT((nn * (nn + 1) / 12 - ties / (12 * (nn - 1))) * (1 / a.n + 1 / b.n)) AS z
FROM sums a JOIN sums b ON a.name = b.name AND a.location < b.location
JOIN whole w ON w.name = a.name JOIN tie t ON t.name = a.name),
tests AS (SELECT *, GREATEST(0, 0.5 - """ + _area("EXP(-x * x / 2)", "LEAST(ABS(z), 40)") + """ / SQRT(2 * PI())) AS p_value FROM pairs),
stepped AS (SELECT *, p_value * COUNT(*) OVER (PARTITION BY name) / COUNT(*) OVER (PARTITION BY name ORDER BY p_value) AS q FROM tests)"""


@query(with_sql(_LONG_LINES, _RANK_SUMS, _DUNN, """SELECT name, group_1, group_2, ROUND(z, 6) AS z, ROUND(p_value, 6) AS p_value,
  ROUND(LEAST(1, MIN(q) OVER (PARTITION BY name ORDER BY p_value DESC)), 6) AS p_adjusted FROM stepped"""))
def dunn_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return ranktests.dunn_pairs(_long_lines(spark, folder))


_P_VALUES = """tests AS (SELECT c_mktsegment AS name, c_custkey AS test, (c_custkey * 37 % 1009 + 1) / 40000.0::DOUBLE AS p_value FROM customer)"""

_ADJUSTED = """adjusted AS (SELECT name, test, p_value, LEAST(1, MIN(q) OVER (PARTITION BY name ORDER BY p_value DESC
    RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_adjusted
FROM (SELECT *, p_value * COUNT(*) OVER (PARTITION BY name) / ROW_NUMBER() OVER (PARTITION BY name ORDER BY p_value) AS q FROM tests))"""


def _tests(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    return read_table(spark, folder, "customer").select(
        F.col("c_mktsegment").alias("name"), key.alias("test"), ((key * 37 % 1009 + 1) / F.lit(40000.0)).alias("p_value")
    )


@query(with_sql(_P_VALUES, _ADJUSTED, """SELECT name, test, ROUND(p_value, 6) AS p_value, ROUND(p_adjusted, 6) AS p_adjusted FROM adjusted"""))
def bh_adjust(spark: SparkSession, folder: str) -> DataFrame:
    return ranktests.adjust_bh(_tests(spark, folder), ["name"])


_KEPT = "kept AS (SELECT *, -LOG10(p_adjusted) AS neglog FROM adjusted WHERE p_adjusted < 0.02)"


@query(with_sql(_P_VALUES, _ADJUSTED, _KEPT, """SELECT name, test, ROUND(p_adjusted, 6) AS p_adjusted, ROUND(neglog, 6) AS neglog_p,
  ROUND(0.4 + 0.6 * (neglog - (SELECT MIN(neglog) FROM kept)) / ((SELECT MAX(neglog) FROM kept) - (SELECT MIN(neglog) FROM kept)), 6) AS alpha_val,
  ROUND(4 + 4 * (neglog - (SELECT MIN(neglog) FROM kept)) / ((SELECT MAX(neglog) FROM kept) - (SELECT MIN(neglog) FROM kept)), 6) AS size_val
FROM kept"""))
def rescaled_significance(spark: SparkSession, folder: str) -> DataFrame:
    kept = ranktests.significant(ranktests.adjust_bh(_tests(spark, folder), ["name"]), level=0.02)
    scaled = summaries.rescale(kept, "neglog_p", {"alpha_val": (0.4, 1), "size_val": (4, 8)})
    return scaled.select("name", "test", "p_adjusted", "neglog_p", "alpha_val", "size_val")


_NULLED = """wide AS (SELECT l_quantity, l_extendedprice, l_tax, CASE WHEN l_partkey % 11 <> 0 THEN l_discount END AS l_discount FROM lineitem)"""


_STUDENT = "EXP(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0) - LN(PI() * (n - 2)) / 2 - (n - 1) / 2.0 * LN(1 + x * x / (n - 2)))"
_PEARSON = "pairs AS (SELECT *, r * SQRT((n - 2) / (1 - r * r)) AS t FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS var, '{b}' AS var2, COUNT(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, CORR({a}, {b}) AS r FROM wide"
    for a, b in correlation.column_pairs(MEASURES)) + "))"


@query(with_sql(_NULLED, _PEARSON, "SELECT var, var2, n, ROUND(r, 6) AS correlation, ROUND(t, 6) AS t, ROUND(GREATEST(0, 1 - 2 * "
                + _area(_STUDENT, "LEAST(ABS(t), 40)") + "), 6) AS p_value FROM pairs"))
def pearson_pairs(spark: SparkSession, folder: str) -> DataFrame:
    wide = read_table(spark, folder, "lineitem").withColumn(
        "l_discount", F.when(F.col("l_partkey") % 11 != 0, F.col("l_discount"))
    )
    return correlation.pearson_pairs(wide, MEASURES)


_SPEARMAN = """SELECT name, COUNT(*) AS n, ROUND(CASE WHEN COUNT(*) = COUNT(x) THEN CORR(rx, ry) END, 6) AS spearman FROM (
  SELECT name, x, RANK() OVER (PARTITION BY name ORDER BY x) + (COUNT(*) OVER (PARTITION BY name, x) - 1) / 2.0 AS rx,
    RANK() OVER (PARTITION BY name ORDER BY y) + (COUNT(*) OVER (PARTITION BY name, y) - 1) / 2.0 AS ry FROM grouped) GROUP BY 1"""


@query(with_sql("""grouped AS (SELECT l_returnflag AS name, MEDIAN(l_extendedprice) AS x, AVG(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0 END) AS y
FROM lineitem GROUP BY l_returnflag, l_suppkey)""", _SPEARMAN))
def spearman_groups(spark: SparkSession, folder: str) -> DataFrame:
    lines = read_table(spark, folder, "lineitem")
    keys = ["l_returnflag", "l_suppkey"]
    medians = quantiles.group_quantiles(lines, keys, "l_extendedprice", {"x": 0.5})
    rates = lines.groupBy(*keys).agg(F.avg((F.col("l_quantity") > 25).cast("int")).alias("y"))
    grouped = medians.join(rates, keys).withColumnRenamed("l_returnflag", "name")
    return correlation.spearman(grouped, ["name"], "x", "y")


_SITE_MEDIANS = "grouped AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS name, MEDIAN({c}) AS x, AVG(CASE WHEN passive > passive_lod THEN 1.0 ELSE 0 END) AS y FROM samples WHERE passive IS NOT NULL GROUP BY site"
    for c in ("tn", "tp", "marker")) + ")"


@query(with_sql(SAMPLES, _SITE_MEDIANS, _SPEARMAN))
def detection_correlation(spark: SparkSession, folder: str) -> DataFrame:
    return correlation.detection_correlation(
        cut(samples(spark, folder)), "site", ["tn", "tp", "marker"], "passive", "passive_lod"
    )


@query("""SELECT event_id, event_type, value, RANK() OVER (PARTITION BY event_type ORDER BY value)
  + (COUNT(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::DOUBLE AS midrank FROM events""")
def midranks(spark: SparkSession, folder: str) -> DataFrame:
    events = read_table(spark, folder, "events").select("event_id", "event_type", "value")
    return ordering.midranks(events, ["event_type"], "value")


_ACF = """m AS (SELECT region, AVG(mean_temp) AS mu FROM daily GROUP BY 1),
lagged AS (SELECT d.region, mean_temp - mu AS x, """ + ", ".join(
    f"LAG(mean_temp - mu, {k}) OVER (PARTITION BY d.region ORDER BY date_time) AS x{k}" for k in (1, 2, 3)
) + """ FROM daily d JOIN m ON d.region = m.region)"""


@query(with_sql(DAILY, _ACF, "SELECT region, 0 AS lag, 1.0::DOUBLE AS acf FROM lagged GROUP BY 1 UNION ALL " + " UNION ALL ".join(
    f"SELECT region, {k} AS lag, ROUND(SUM(x * x{k}) / SUM(x * x), 6) AS acf FROM lagged GROUP BY 1" for k in (1, 2, 3))))
def residual_acf(spark: SparkSession, folder: str) -> DataFrame:
    return timeseries.autocorrelation(cut(daily(spark, folder)), ["region"], "date_time", "mean_temp", 3)


@query("SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(
    f"ROUND((l_{c} - (SELECT AVG(l_{c}) FROM lineitem)) / (SELECT STDDEV_SAMP(l_{c}) FROM lineitem), 6) AS s_l_{c}"
    for c in ("quantity", "extendedprice")) + " FROM lineitem")
def zscores(spark: SparkSession, folder: str) -> DataFrame:
    lines = read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"
    )
    return scaling.zscores(lines, ["l_quantity", "l_extendedprice"]).drop("l_quantity", "l_extendedprice")


@query(with_sql(SAMPLES, """SELECT s.site, sample_date, ROUND(CASE WHEN sd > 0 THEN (tn - mu) / sd END, 6) AS s_tn FROM samples s
JOIN (SELECT site, AVG(tn) AS mu, STDDEV_SAMP(tn) AS sd FROM samples GROUP BY 1) k ON s.site = k.site"""))
def zscores_by_site(spark: SparkSession, folder: str) -> DataFrame:
    scored = scaling.zscores(samples(spark, folder).select("site", "sample_date", "tn"), ["tn"], by=["site"])
    return scored.drop("tn")


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS name, ROUND(AVG({c}), 6) AS center, ROUND(STDDEV_SAMP({c}), 6) AS scale FROM lineitem" for c in MEASURES))
def scaling_constants(spark: SparkSession, folder: str) -> DataFrame:
    return scaling.scaling_constants(read_table(spark, folder, "lineitem"), MEASURES)


@query("""SELECT o_orderkey, ROUND((o_totalprice / 10 - k.center) / k.scale, 6) AS scaled,
  ROUND(o_totalprice / 10, 6) AS restored
FROM orders, (SELECT AVG(l_extendedprice) AS center, STDDEV_SAMP(l_extendedprice) AS scale FROM lineitem) k""")
def scaling_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """New values scaled with the constants of another table, and back."""
    constants = scaling.scaling_constants(read_table(spark, folder, "lineitem"), ["l_extendedprice"])
    orders = read_table(spark, folder, "orders").select("o_orderkey", (F.col("o_totalprice") / 10).alias("price"))
    scaled = scaling.apply_scaling(orders, "price", constants, "l_extendedprice", "scaled")
    return scaling.undo_scaling(scaled, "scaled", constants, "l_extendedprice", "restored").drop("price")


@query("""SELECT event_id, event_type, ROUND(SUM(value) OVER w, 6) AS cum_sum, MIN(value) OVER w AS cum_min, MAX(value) OVER w AS cum_max,
  COUNT(*) OVER (PARTITION BY event_type) AS n_in_group
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def cumulative_stats(spark: SparkSession, folder: str) -> DataFrame:
    events = read_table(spark, folder, "events").select("event_id", "event_type", "ts", "value")
    return summaries.cumulative(events, ["event_type"], "ts", ["event_id"], "value").drop("ts", "value")


@query("SELECT event_id, value, ROW_NUMBER() OVER (ORDER BY value DESC, event_id) AS position FROM events")
def sorted_positions(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every row in a whole-table sort, without one task holding the table."""
    events = read_table(spark, folder, "events").select("event_id", "value")
    return ordering.positions(events, [], "value", ["event_id"], descending=True)


@query("""SELECT event_id, event_type, ROW_NUMBER() OVER (ORDER BY event_type DESC, event_id) AS position FROM events""")
def sorted_text(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every row in a sort by text, from the last value to the first; a few values fill the table."""
    events = read_table(spark, folder, "events").select("event_id", "event_type")
    return ordering.positions(events, [], "event_type", ["event_id"], descending=True)


@query("""SELECT event_id, value, ROW_NUMBER() OVER (ORDER BY ABS(value) DESC, event_id) AS position FROM events""")
def sorted_abs(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every row by the size of a value, whatever its sign."""
    events = read_table(spark, folder, "events").select("event_id", "value")
    return ordering.positions(events, [], "value", ["event_id"], descending=True, absolute=True)


@query("""SELECT * EXCLUDE (r) FROM (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity,
  RANK() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS r FROM lineitem) WHERE r <= 5""")
def top_k_ties(spark: SparkSession, folder: str) -> DataFrame:
    lines = read_table(spark, folder, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    return summaries.top_with_ties(lines, ["l_suppkey"], "l_quantity", 5)


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey
  ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1""")
def first_rows(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return summaries.first_row(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


_MODEL_ROWS = """prepared AS (SELECT site AS location, sample_date, CAST(year(sample_date) AS INT) AS year, tn,
    CASE WHEN marker IS NULL OR marker > marker_lod THEN 'none' ELSE 'left' END AS cens_mcye,
    LOG10(CASE WHEN marker < marker_lod THEN marker_lod ELSE marker END) AS mcye,
    LOG10(CASE WHEN total < total_lod THEN total_lod ELSE total END) AS total_cyano,
    CASE WHEN passive > passive_lod THEN 1 WHEN passive <= passive_lod THEN 0 END AS passive_mclr_binary FROM samples),
lagged AS (SELECT *, LAG(mcye) OVER w AS lag_mcye, COALESCE(LAG(cens_mcye) OVER w, 'none') AS cens_lag_mcye
  FROM prepared WINDOW w AS (PARTITION BY location ORDER BY sample_date))"""


@query(with_sql(SAMPLES, _MODEL_ROWS, """SELECT location, sample_date, CAST(location AS VARCHAR) || '.' || CAST(year AS VARCHAR) AS location_year,
  CAST(week(sample_date) AS INT) AS week_of_year, cens_mcye, cens_lag_mcye, ROUND(mcye / total_cyano, 6) AS ratio, passive_mclr_binary,
  ROUND((mcye - (SELECT AVG(mcye) FROM lagged)) / (SELECT STDDEV_SAMP(mcye) FROM lagged), 6) AS s_mcye,
  ROUND((lag_mcye - (SELECT AVG(lag_mcye) FROM lagged)) / (SELECT STDDEV_SAMP(lag_mcye) FROM lagged), 6) AS s_lag_mcye,
  ROUND((tn - (SELECT AVG(tn) FROM lagged)) / (SELECT STDDEV_SAMP(tn) FROM lagged), 6) AS s_tn
FROM lagged WHERE passive_mclr_binary IS NOT NULL"""))
def model_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The preparation chain of the detection model: flags, limits, logs, lags, z-scores, filter."""
    named = rename(cut(samples(spark, folder)), {
        "location": "site", "mcye_ndaf": "marker", "lod_mcye_ndaf": "marker_lod", "total_cyano": "total",
        "lod_total_cyano": "total_lod", "passive_mclr": "passive", "passive_mclr_lod": "passive_lod",
    })
    dated = named.withColumns({"year": F.year("sample_date"), "week": F.dayofyear("sample_date")})
    rows, _ = predict.model_table(dated, ["mcye", "lag_mcye", "tn"])
    return rows.select(
        "location", "sample_date", "location_year", "week_of_year", "cens_mcye", "cens_lag_mcye", "ratio",
        "passive_mclr_binary", "s_mcye", "s_lag_mcye", "s_tn",
    )
