"""Cleaning, reshaping, joining: from raw tables to the analysis table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnkit.functions import censoring as C
from tarnkit.functions.dates import iso_week, iso_year
from tarnkit.functions.semantics import if_else3, in_order, interaction, keep_unless, paste
from tarnkit.operators import cleaning, correlation, joins, reshape, selectors, summaries, timeseries
from tarnkit.operators.quantiles import group_quantiles
from tarnkit.plans.bindings import (
    DAILY, MEASURES, SAMPLES, SCORES, STATIONS, daily, samples, scores, stations, with_sql,
)
from tarnkit.plans.registry import query
from tarnkit.session import cut
from tarnkit.sources.tables import read_table

_CHEM = ", ".join(f"ROUND(MEDIAN({c}), 3) AS median_{c}, ROUND(STDDEV_SAMP({c}), 3) AS sd_{c}" for c in MEASURES)


@query(f"SELECT l_returnflag, CAST(year(l_shipdate) AS INT) AS year, {_CHEM} FROM lineitem GROUP BY 1, 2")
def chem_table_yearly(spark: SparkSession, folder: str) -> DataFrame:
    lines = read_table(spark, folder, "lineitem").withColumn("year", F.year("l_shipdate"))
    return summaries.chemistry_table(lines, ["l_returnflag", "year"], MEASURES, digits=3)


@query(f"SELECT l_suppkey, {_CHEM} FROM lineitem GROUP BY 1")
def chem_table(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.chemistry_table(read_table(spark, folder, "lineitem"), ["l_suppkey"], MEASURES, digits=3)


_METHODS = ["grab", "passive", "spe", "marker", "total", "tn", "tp"]


@query(with_sql(SAMPLES, "SELECT name, ROUND(prop_missing, 6) AS prop_missing FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS name, AVG(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS prop_missing FROM samples"
    for c in _METHODS) + ")"))
def missing_fraction(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.missing_fraction(samples(spark, folder), _METHODS)


@query(with_sql(SAMPLES, """SELECT site, sample_date, spe, spe_lod, tn, tp, region FROM samples"""))
def drop_sparse_columns(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.drop_sparse_columns(samples(spark, folder), _METHODS, 0.4, exempt="spe")


@query(with_sql(SAMPLES, """SELECT site, sample_date, CASE region WHEN 'nb' THEN 'New Brunswick' ELSE region END AS region
FROM samples"""))
def recode_sites(spark: SparkSession, folder: str) -> DataFrame:
    table = samples(spark, folder).select("site", "sample_date", "region")
    return cleaning.recode_column(table, "region", {"nb": "New Brunswick"})


@query("""SELECT event_type, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END AS ord,
  CAST(RANK() OVER (ORDER BY MEDIAN(value), event_type) AS INT) AS by_median, ROUND(MEDIAN(value), 6) AS median
FROM events GROUP BY event_type""")
def ordered_sites(spark: SparkSession, folder: str) -> DataFrame:
    middle = group_quantiles(read_table(spark, folder, "events"), ["event_type"], "value", {"median": 0.5})
    ranked = cleaning.ordered_levels(middle, "event_type", ["view", "click", "purchase"])
    by_median = cleaning.level_rank(ranked, "event_type", "median", "by_median")
    return by_median.select("event_type", "ord", "by_median", "median")


@query(with_sql(SAMPLES, "SELECT site, sample_date, COALESCE(grab, spe) AS grab, grab_lod FROM samples"))
def coalesce_methods(spark: SparkSession, folder: str) -> DataFrame:
    return samples(spark, folder).select(
        "site", "sample_date", cleaning.prefer("grab", "spe").alias("grab"), "grab_lod"
    )


@query(with_sql(SAMPLES, """SELECT site, sample_date, ROUND((tn / 14) / (tp / 1000 / 31), 6) AS tn_tp_ratio,
  ROUND((marker / 12) / (tn / 14), 6) AS tc_tn_ratio, ROUND((marker / 12) / (tp / 1000 / 31), 6) AS tc_tp_ratio
FROM samples"""))
def molar_ratios(spark: SparkSession, folder: str) -> DataFrame:
    return samples(spark, folder).select(
        "site", "sample_date",
        C.nitrogen_phosphorus("tn", "tp").alias("tn_tp_ratio"),
        C.carbon_nitrogen("marker", "tn").alias("tc_tn_ratio"),
        C.carbon_phosphorus("marker", "tp").alias("tc_tp_ratio"),
    )


@query("SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def key_violations(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.key_violations(read_table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT l_suppkey AS site, CAST(isoyear(l_shipdate) AS INT) AS isoyear, CAST(week(l_shipdate) AS INT) AS week,
  MAX(l_quantity) AS l_quantity, MAX(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1, 2, 3""")
def weekly_max(spark: SparkSession, folder: str) -> DataFrame:
    lines = read_table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("site"), iso_year("l_shipdate").alias("isoyear"), iso_week("l_shipdate").alias("week"),
        "l_quantity", "l_extendedprice",
    )
    return cleaning.one_per_period(lines, ["site", "isoyear", "week"], ["l_quantity", "l_extendedprice"])


@query(with_sql(SAMPLES, "SELECT tn AS nitrogen, tp AS phosphorus, site, sample_date, grab, grab_lod FROM samples"))
def rename_relocate(spark: SparkSession, folder: str) -> DataFrame:
    table = selectors.select_cols(
        samples(spark, folder), "site", "sample_date", selectors.contains("grab"), selectors.matches("^t[np]$")
    )
    table = selectors.rename(table, {"nitrogen": "tn", "phosphorus": "tp"})
    table = selectors.relocate(table, "nitrogen", "phosphorus")
    return selectors.relocate(table, selectors.contains("lod"), last=True)


@query(with_sql(SAMPLES, """SELECT site, sample_date, ROUND(tn / 1000, 6) AS tn_mg, ROUND(tn / 1000 / 14, 6) AS tn_mmol,
  CAST(year(sample_date) AS INT) AS year FROM samples"""))
def derived_columns(spark: SparkSession, folder: str) -> DataFrame:
    table = samples(spark, folder).select("site", "sample_date", "tn")
    return in_order(
        table, tn_mg=F.col("tn") / 1000, tn_mmol=F.col("tn_mg") / 14, year=F.year("sample_date")
    ).drop("tn")


@query("""SELECT event_id, event_type, value FROM events
WHERE event_type IN ('view', 'purchase', 'click') AND month(ts) BETWEEN 1 AND 12
  AND NOT COALESCE(event_type = 'view' AND value > 250, FALSE)
  AND NOT COALESCE(event_type = 'click' AND value > 100, FALSE)""")
def row_filters(spark: SparkSession, folder: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    return (
        read_table(spark, folder, "events")
        .filter(kind.isin("view", "purchase", "click") & F.month("ts").between(1, 12))
        .filter(keep_unless((kind == "view") & (value > 250), (kind == "click") & (value > 100)))
        .select("event_id", "event_type", "value")
    )


@query(with_sql(SAMPLES, """SELECT site, sample_date, CASE WHEN grab > grab_lod THEN 'high' WHEN NOT grab > grab_lod THEN 'low' END AS grab_class,
  CASE WHEN passive > 2 * passive_lod THEN 'strong' WHEN passive > passive_lod THEN 'weak' ELSE 'none' END AS passive_class
FROM samples"""))
def conditional_columns(spark: SparkSession, folder: str) -> DataFrame:
    passive, limit = F.col("passive"), F.col("passive_lod")
    return samples(spark, folder).select(
        "site", "sample_date",
        if_else3(F.col("grab") > F.col("grab_lod"), F.lit("high"), F.lit("low")).alias("grab_class"),
        F.when(passive > 2 * limit, "strong").when(passive > limit, "weak").otherwise("none").alias("passive_class"),
    )


@query(with_sql(SAMPLES, "SELECT site, sample_date, COALESCE(grab, 0) AS grab, COALESCE(spe, -1) AS spe FROM samples"))
def fill_nulls(spark: SparkSession, folder: str) -> DataFrame:
    table = samples(spark, folder).select("site", "sample_date", "grab", "spe")
    return cleaning.fill_nulls(table, {"grab": 0.0, "spe": -1.0})


@query(with_sql(SAMPLES, """SELECT site, sample_date, CAST(site AS VARCHAR) || '.' || CAST(year(sample_date) AS VARCHAR) AS location_year,
  region || ' / ' || COALESCE(CAST(CAST(FLOOR(grab) AS BIGINT) AS VARCHAR), 'NA') AS label FROM samples"""))
def interaction_key(spark: SparkSession, folder: str) -> DataFrame:
    return samples(spark, folder).select(
        "site", "sample_date", interaction("site", F.year("sample_date")).alias("location_year"),
        paste("region", F.lit("/"), F.floor("grab"), sep=" ").alias("label"),
    )


@query(with_sql(SAMPLES, """SELECT site, sample_date, ROUND(marker * 100 / (20 + site % 30), 6) AS copies,
  ROUND(9.0 * 100 / (20 + site % 30), 6) AS copies_lod FROM samples"""))
def gene_copies(spark: SparkSession, folder: str) -> DataFrame:
    filtered = 20 + F.col("site") % 30
    return samples(spark, folder).select(
        "site", "sample_date",
        C.gene_copies("marker", F.lit(100.0), filtered).alias("copies"),
        C.gene_copies(F.lit(9.0), F.lit(100.0), filtered).alias("copies_lod"),
    )


_LONG = "UNION ALL".join(f" SELECT site, sample_date, '{c}' AS name, {c} AS value FROM samples "
                         for c in ("grab", "passive", "marker", "tn"))


@query(with_sql(SAMPLES, _LONG))
def long_measurements(spark: SparkSession, folder: str) -> DataFrame:
    return reshape.longer(samples(spark, folder), ["site", "sample_date"], ["grab", "passive", "marker", "tn"])


@query(with_sql(SAMPLES, """SELECT site, sample_date, 'grab' AS method, grab AS value, grab_lod AS lod FROM samples
UNION ALL SELECT site, sample_date, 'passive', passive, passive_lod FROM samples"""))
def long_value_lod(spark: SparkSession, folder: str) -> DataFrame:
    table = selectors.rename(
        samples(spark, folder).select("site", "sample_date", "grab", "grab_lod", "passive", "passive_lod"),
        {"grab_value": "grab", "passive_value": "passive"},
    )
    return reshape.longer_paired(table, ["site", "sample_date"])


@query(with_sql(STATIONS, """SELECT station, date_time, """ + ", ".join(
    f"ROUND(AVG(value) FILTER (WHERE param = '{p}'), 6) AS {p}" for p in ("click", "error", "view"))
    + " FROM stations GROUP BY 1, 2"))
def climate_wide(spark: SparkSession, folder: str) -> DataFrame:
    return reshape.wider(
        stations(spark, folder), ["station", "date_time"], "param", ["click", "error", "view"],
        {"": F.avg("value")},
    )


@query(with_sql(DAILY, """SELECT region, date_time,
  CASE WHEN rn >= 7 THEN ROUND(COALESCE(SUM(total_precip) OVER w7, 0), 6) END AS precip_7d_sum,
  CASE WHEN rn >= 3 THEN ROUND(COALESCE(SUM(total_precip) OVER w3, 0), 6) END AS precip_3d_sum,
  CASE WHEN rn >= 7 THEN ROUND(AVG(mean_temp) OVER w7, 6) END AS temp_7d_mean,
  CASE WHEN rn >= 3 THEN ROUND(AVG(max_temp) OVER w3, 6) END AS temp_3d_avgmax
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY region ORDER BY date_time) AS rn FROM daily)
WINDOW w7 AS (PARTITION BY region ORDER BY date_time ROWS 6 PRECEDING),
       w3 AS (PARTITION BY region ORDER BY date_time ROWS 2 PRECEDING)"""))
def rolling_climate(spark: SparkSession, folder: str) -> DataFrame:
    frames = {
        "precip_7d_sum": ("sum", "total_precip", 7),
        "precip_3d_sum": ("sum", "total_precip", 3),
        "temp_7d_mean": ("mean", "mean_temp", 7),
        "temp_3d_avgmax": ("mean", "max_temp", 3),
    }
    rolled = timeseries.rolling(cut(daily(spark, folder)), ["region"], "date_time", frames)
    return rolled.select("region", "date_time", *frames)


@query(with_sql(STATIONS, """SELECT station, date_time,
  ROUND(SUM(SUM(value)) OVER w, 6) AS sum_3d, ROUND(SUM(SUM(value)) OVER w / SUM(COUNT(value)) OVER w, 6) AS mean_3d
FROM stations GROUP BY station, date_time
WINDOW w AS (PARTITION BY station ORDER BY date_time RANGE BETWEEN INTERVAL 2 DAYS PRECEDING AND CURRENT ROW)"""))
def rolling_climate_days(spark: SparkSession, folder: str) -> DataFrame:
    frames = {"sum_3d": ("sum", "value", 3), "mean_3d": ("mean", "value", 3)}
    return timeseries.rolling_days(stations(spark, folder), ["station"], "date_time", frames)


@query(with_sql(SAMPLES, """SELECT site, sample_date, LAG(marker) OVER w AS lag_marker, LAG(tn, 2) OVER w AS lag2_tn,
  COALESCE(LAG(CASE WHEN marker IS NULL OR marker > marker_lod THEN 'none' ELSE 'left' END) OVER w, 'none') AS cens_lag
FROM samples WINDOW w AS (PARTITION BY site ORDER BY sample_date)"""))
def lagged_predictors(spark: SparkSession, folder: str) -> DataFrame:
    table = cut(samples(spark, folder)).withColumn("_cens", C.censoring("marker", "marker_lod"))
    lagged = timeseries.lags(
        table, ["site"], "sample_date",
        {"lag_marker": ("marker", 1), "lag2_tn": ("tn", 2), "cens_lag": ("_cens", 1)},
    )
    lagged = cleaning.fill_nulls(lagged, {"cens_lag": "none"})
    return lagged.select("site", "sample_date", "lag_marker", "lag2_tn", "cens_lag")


@query(with_sql(SAMPLES, DAILY, """SELECT s.site, s.sample_date, s.region, ROUND(d.mean_temp, 6) AS mean_temp, d.max_temp
FROM samples s LEFT JOIN daily d ON s.sample_date = d.date_time AND s.region = d.region"""))
def site_climate_join(spark: SparkSession, folder: str) -> DataFrame:
    weather = daily(spark, folder).drop("total_precip")
    table = samples(spark, folder).select("site", "sample_date", "region")
    return joins.lookup_join(table, weather, {"sample_date": "date_time", "region": "region"}, "left", derived=True)


@query(with_sql(SAMPLES, """SELECT s.site, s.sample_date, s.grab, d.n AS n_same_grab FROM samples s
LEFT JOIN (SELECT grab, COUNT(*) AS n FROM samples GROUP BY 1) d ON s.grab IS NOT DISTINCT FROM d.grab"""))
def null_safe_join(spark: SparkSession, folder: str) -> DataFrame:
    table = samples(spark, folder).select("site", "sample_date", "grab")
    counts = table.groupBy("grab").agg(F.count(F.lit(1)).alias("n_same_grab"))
    return joins.lookup_join(table, counts, "grab", "left", null_safe=True, derived=True)


@query("""SELECT s_suppkey, s_acctbal, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def site_lookup_join(spark: SparkSession, folder: str) -> DataFrame:
    nations = read_table(spark, folder, "nation").select("n_nationkey", "n_name")
    suppliers = read_table(spark, folder, "supplier")
    joined = joins.lookup_join(suppliers, nations, {"s_nationkey": "n_nationkey"}, "inner")
    return joined.select("s_suppkey", "s_acctbal", "n_name")


@query(with_sql(SAMPLES, """SELECT site, sample_date,
  site IN (SELECT site FROM samples WHERE grab > grab_lod) AS grab_site FROM samples"""))
def shared_flag(spark: SparkSession, folder: str) -> DataFrame:
    table = cut(samples(spark, folder))
    found = table.filter(C.detected("grab", "grab_lod")).select("site")
    return joins.flag_matching(table.select("site", "sample_date"), found, "site", "grab_site")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def rows_in_value_list(spark: SparkSession, folder: str) -> DataFrame:
    customers = read_table(spark, folder, "customer").filter("c_acctbal > 0")
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").alias("c_custkey"))
    return joins.keep_matching(orders, customers, "c_custkey").select("o_orderkey", "o_totalprice")


_PAIRED = ["grab", "passive", "marker", "tn"]


@query(with_sql(SAMPLES, " UNION ALL ".join(
    f"SELECT '{a}' AS var, '{b}' AS var2, COUNT(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM samples"
    for a, b in correlation.column_pairs(_PAIRED))))
def pair_grid(spark: SparkSession, folder: str) -> DataFrame:
    return correlation.pair_grid(samples(spark, folder), _PAIRED)


@query(with_sql(SCORES, """SELECT split_part(model, '_', 1) AS scheme, split_part(model, '_', 2) AS held_out, imp, row_id
FROM scores"""))
def split_column(spark: SparkSession, folder: str) -> DataFrame:
    table = scores(spark, folder).select("model", "imp", "row_id")
    return reshape.split_in_two(table, "model", ["scheme", "held_out"], "_").select("scheme", "held_out", "imp", "row_id")


@query(with_sql(SAMPLES, """SELECT region, COUNT(*) AS n, ROUND(AVG(rate), 6) AS mean_rate, ROUND(MAX(rate) - MIN(rate), 6) AS spread
FROM (SELECT region, sample_date, AVG(CASE WHEN passive > passive_lod THEN 1.0 ELSE 0.0 END) AS rate
      FROM samples WHERE passive IS NOT NULL GROUP BY 1, 2) GROUP BY 1"""))
def grouped_apply(spark: SparkSession, folder: str) -> DataFrame:
    """The per-group fall-back runs on daily rates, a table bounded by the number of dates."""
    rates = (
        samples(spark, folder).filter(F.col("passive").isNotNull())
        .groupBy("region", "sample_date")
        .agg(F.avg(C.detected("passive", "passive_lod").cast("int")).alias("rate"))
    )

    def spread(pdf):
        return pdf.groupby("region", as_index=False).agg(
            n=("rate", "size"), mean_rate=("rate", "mean"), spread=("rate", lambda r: r.max() - r.min())
        )

    return reshape.per_group(rates, ["region"], spread, "region string, n bigint, mean_rate double, spread double")


@query("SELECT o_orderkey, o_totalprice, n_lines, quantity FROM orders JOIN (SELECT l_orderkey, COUNT(*) AS n_lines, "
       "SUM(l_quantity) AS quantity FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def key_bind(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    lines = read_table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity")
    )
    return joins.bind_by_key(orders, lines, "o_orderkey")


@query(with_sql(STATIONS, "SELECT station, date_time, param, ROUND(AVG(value), 6) AS value FROM stations GROUP BY 1, 2, 3"))
def group_mean(spark: SparkSession, folder: str) -> DataFrame:
    return stations(spark, folder).groupBy("station", "date_time", "param").agg(F.avg("value").alias("value"))


@query("SELECT l_suppkey, " + ", ".join(
    f"ROUND(AVG({c}), 6) AS mean_{c}, MIN({c}) AS min_{c}, MAX({c}) AS max_{c}" for c in MEASURES)
    + " FROM lineitem GROUP BY 1")
def across_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    columns = summaries.across(MEASURES, {"mean": F.avg, "min": F.min, "max": F.max})
    return read_table(spark, folder, "lineitem").groupBy("l_suppkey").agg(*columns)


@query("SELECT l_returnflag, l_linestatus, " + ", ".join(
    f"ROUND(QUANTILE_CONT(l_extendedprice, {p}), 6) AS {n}" for n, p in (("q025", .025), ("q25", .25), ("q975", .975)))
    + " FROM lineitem GROUP BY 1, 2")
def quantile_summary(spark: SparkSession, folder: str) -> DataFrame:
    return group_quantiles(
        read_table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice",
        {"q025": 0.025, "q25": 0.25, "q975": 0.975},
    )


@query(with_sql(SCORES, """SELECT model, imp, COUNT(*) FILTER (WHERE truth = 'detected') AS n_detected,
  COUNT(*) FILTER (WHERE truth = 'not_detected') AS n_not_detected FROM scores GROUP BY 1, 2"""))
def class_counts(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.class_counts(scores(spark, folder), ["model", "imp"], "truth", ["detected", "not_detected"])


@query("""SELECT lake, COUNT(DISTINCT c_name) AS n_sites FROM
  (SELECT c_name, trim(regexp_replace(c_mktsegment || ' ' || CAST(c_nationkey AS VARCHAR), '[0-9]+', '', 'g')) AS lake
   FROM customer) GROUP BY 1""")
def distinct_sites(spark: SparkSession, folder: str) -> DataFrame:
    site = F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string"))
    named = read_table(spark, folder, "customer").select(
        "c_name", F.trim(F.regexp_replace(site, "[0-9]+", "")).alias("lake")
    )
    return named.distinct().groupBy("lake").agg(F.count("c_name").alias("n_sites"))


@query("""SELECT event_id, ROUND((value - (SELECT MIN(value) FROM events)) /
  ((SELECT MAX(value) FROM events) - (SELECT MIN(value) FROM events)), 6) AS share FROM events""")
def range_scalars(spark: SparkSession, folder: str) -> DataFrame:
    table = read_table(spark, folder, "events").select("event_id", "value")
    return summaries.rescale(table, "value", {"share": (0, 1)}).select("event_id", "share")


@query(with_sql(SCORES, """SELECT model, truth, ROUND(QUANTILE_CONT(m, 0.25), 6) AS lower, ROUND(MEDIAN(m), 6) AS middle,
  ROUND(QUANTILE_CONT(m, 0.75), 6) AS upper
FROM (SELECT model, truth, imp, MEDIAN(score) AS m FROM scores GROUP BY 1, 2, 3) GROUP BY 1, 2"""))
def two_stage_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.two_stage_quantiles(
        scores(spark, folder), ["imp"], ["model", "truth"], "score", {"lower": 0.25, "middle": 0.5, "upper": 0.75}
    )


@query(with_sql(SCORES, """SELECT 'labelled' AS source, CAST(row_id AS BIGINT) AS id, ROUND(score, 6) AS score FROM scores
UNION ALL SELECT 'events', event_id, ROUND(value, 6) FROM events"""))
def union_with_id(spark: SparkSession, folder: str) -> DataFrame:
    labelled = scores(spark, folder).select(F.col("row_id").alias("id"), "score")
    events = read_table(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("value").alias("score"))
    return joins.stack({"labelled": labelled, "events": events}, "source")


@query("SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_intersect(spark: SparkSession, folder: str) -> DataFrame:
    rich = read_table(spark, folder, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"))
    selling = read_table(spark, folder, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation"))
    return joins.common_values(rich, selling)


@query("SELECT c_custkey AS site FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_difference(spark: SparkSession, folder: str) -> DataFrame:
    known = read_table(spark, folder, "customer").select(F.col("c_custkey").alias("site"))
    finished = read_table(spark, folder, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("site"))
    return joins.values_only_in(known, finished)
