"""Comparison of models by pointwise log predictive density."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnkit.functions.semantics import count_true
from tarnkit.operators.joins import equi_join


def compare_models(pointwise: DataFrame, model: str = "model", obs: str = "obs", lpd: str = "lpd") -> DataFrame:
    """Expected log predictive density per model with its standard error, the difference to the best model
    with the standard error of the paired difference, LOOIC and its distance to the smallest LOOIC.

    Rows are (model, obs, lpd). The best model's densities are matched by observation.
    """
    totals = pointwise.groupBy(model).agg(F.sum(lpd).alias("elpd"))
    best = totals.agg(F.max_by(model, F.struct("elpd", F.col(model)))).scalar()
    reference = pointwise.filter(F.col(model) == best).select(F.col(obs), F.col(lpd).alias("_best"))
    paired = equi_join(pointwise, reference, obs, "left").withColumn("_diff", F.col(lpd) - F.col("_best"))
    n = F.count(F.lit(1))
    table = paired.groupBy(model).agg(
        n.alias("n_obs"),
        F.sum(lpd).alias("elpd_loo"),
        (F.sqrt(n) * F.stddev_samp(lpd)).alias("se_elpd_loo"),
        F.sum("_diff").alias("elpd_diff"),
        (F.sqrt(n) * F.stddev_samp("_diff")).alias("se_diff"),
    )
    table = table.withColumn("looic", -2 * F.col("elpd_loo")).withColumn("se_looic", 2 * F.col("se_elpd_loo"))
    top = totals.agg(F.max("elpd")).scalar()
    return table.withColumn("delta_looic", F.col("looic") + 2 * top)


def diagnostic_counts(
    pointwise: DataFrame, thresholds: Mapping[str, float] | None = None, model: str = "model", khat: str = "khat"
) -> DataFrame:
    """How many observations exceed each diagnostic threshold, per model."""
    thresholds = thresholds or {"n_khat_gt_07": 0.7, "n_khat_gt_1": 1.0}
    return pointwise.groupBy(model).agg(*[count_true(F.col(khat) > v).alias(n) for n, v in thresholds.items()])


def comparison_table(pointwise: DataFrame, digits: int = 2) -> DataFrame:
    """Model comparison joined with the diagnostic counts, rounded."""
    compared = equi_join(compare_models(pointwise), diagnostic_counts(pointwise), "model", "left")
    real = [f.name for f in compared.schema.fields if f.dataType.typeName() == "double"]
    return compared.withColumns({c: F.round(c, digits) for c in real})
