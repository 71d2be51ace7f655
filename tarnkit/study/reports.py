"""Tables of the study: chemistry, rank tests, correlations and detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnkit.functions import censoring as C
from tarnkit.functions.semantics import divide, in_order, paste, recode
from tarnkit.operators import correlation, detections, ranktests, summaries
from tarnkit.operators.cleaning import verify_unique
from tarnkit.operators.reshape import longer
from tarnkit.operators.selectors import rename
from tarnkit.study import names as N


def with_units(table: DataFrame) -> DataFrame:
    """Chloride in mg/L, nitrogen in µg/L, and units in the column names."""
    table = table.withColumns({"chloride": F.col("chloride") / 1000, "tn": F.col("tn") * 1000})
    return rename(table, {"chloride_mgl": "chloride", "tn_ugl": "tn", "p_ugl": "p", "toc_mgl": "toc", "doc_mgl": "doc"})


def chemistry_tables(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Medians and standard deviations per site, and per site and year."""
    units = with_units(table)
    return tuple(
        summaries.chemistry_table(units, keys, N.TABLE_COLUMNS) for keys in (["location"], ["location", "year"])
    )


def site_tests(table: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Kruskal-Wallis per analyte, and Dunn's test for every pair of sites."""
    columns = columns or N.CHEMISTRY
    long = longer(with_units(table).select("location", *columns), ["location"], columns)
    tests = ranktests.kruskal_wallis(long)
    shown = F.when(F.col("p_value") < 0.05, "<0.05").otherwise(F.round("p_value", 2).cast("string"))
    return tests.withColumn("p_value_tidy", shown), ranktests.dunn_pairs(long)


def gene_levels(table: DataFrame) -> DataFrame:
    """Genes on the log scale with values below their limit at zero, and their ratio."""
    return in_order(
        table,
        total_cyano=C.log10_or_zero("total_cyano", "lod_total_cyano"),
        mcye_ndaf=C.log10_or_zero("mcye_ndaf", "lod_mcye_ndaf"),
        ratio=divide("mcye_ndaf", "total_cyano"),
    )


def site_detections(table: DataFrame) -> DataFrame:
    """Passive-sampler detections per site with the label ``site<br>(k / n)``, most detections first."""
    verify_unique(table, ["location", "sample_date"])
    summary = detections.detection_summary(table, ["location"], "passive_mclr", "passive_mclr_lod")
    short = summary.withColumn("location", recode("location", N.SHORT_LABELS)).withColumnRenamed("label", "det_rate")
    label = paste("location", F.lit("<br>("), "det_rate", F.lit(")"))
    return short.withColumn("label", label).orderBy(F.desc("n_detections"), "location")


def detection_correlations(table: DataFrame) -> DataFrame:
    """Spearman correlation of site medians of nutrients with the site's passive detection rate."""
    units = with_units(table.withColumn("tn_tp_ratio", C.nitrogen_phosphorus("tn", "p")))
    return correlation.detection_correlation(
        units, "location", ["p_ugl", "tn_ugl", "colour", "toc_mgl", "tn_tp_ratio"], "passive_mclr", "passive_mclr_lod"
    )


def grab_and_passive(table: DataFrame) -> DataFrame:
    """How often the passive sampler detected with, one and two samples before each grab detection."""
    dated = table.withColumn("year", F.year("sample_date"))
    return detections.paired_detections(
        dated, ["location", "year"], "sample_date", ("grab_mclr", "grab_mclr_lod"), ("passive_mclr", "passive_mclr_lod")
    )
