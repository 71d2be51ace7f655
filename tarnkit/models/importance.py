"""Variable importance over imputations and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnkit.models.roc import model_type
from tarnkit.operators.joins import common_values, flag_matching
from tarnkit.operators.quantiles import small_group_quantiles
from tarnkit.operators.summaries import percent_of_max, top_with_ties


def importance_summary(importance: DataFrame, year_suffix: str = "_2024") -> DataFrame:
    """Relative importance (model_type, variable, avg_importance, lower, upper) from rows of
    (model, imp, variable, importance): median over imputations, percent of the model's best variable,
    median and quartiles over models.
    """
    medians = importance.groupBy("model", "variable").agg(F.percentile("importance", 0.5).alias("importance"))
    relative = percent_of_max(medians, ["model"], "importance", "_relative")
    return relative.withColumn("model_type", model_type("model", year_suffix)).groupBy("model_type", "variable").agg(
        *small_group_quantiles("_relative", {"avg_importance": 0.5, "lower": 0.25, "upper": 0.75})
    )


def top_shared(first: DataFrame, second: DataFrame, targets: tuple[str, str], n: int = 15) -> DataFrame:
    """Top-n variables of two summaries (ties kept), each flagged if it is in both lists."""
    tops = [top_with_ties(df, [], "avg_importance", n) for df in (first, second)]
    shared = common_values(*[t.select("variable") for t in tops])
    parts = [t.withColumn("target", F.lit(name)) for t, name in zip(tops, targets)]
    flagged = flag_matching(parts[0].unionByName(parts[1]), shared, "variable", "_shared")
    label = F.when(F.col("_shared"), "Shared predictor").otherwise("Not shared")
    return flagged.select("target", "variable", "avg_importance", label.alias("shared"))
