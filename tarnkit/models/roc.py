"""ROC analysis of prediction tables with one row per (model, imp, row): truth label and score.

Scores are reduced to positive and negative counts per distinct score before anything is ordered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnkit.functions.semantics import count_true, recode
from tarnkit.operators.joins import expand_grid
from tarnkit.operators.ordering import running
from tarnkit.operators.quantiles import group_quantiles, small_group_quantiles, value_counts
from tarnkit.session import cut

FIT = ("model", "imp")


def _score_counts(df: DataFrame, keys: Sequence[str], truth: str, score: str, positive: str) -> DataFrame:
    labelled = df.filter(F.col(truth).isNotNull())
    is_positive = F.col(truth) == F.lit(positive)
    return value_counts(
        labelled, keys, score, {"pos": count_true(is_positive), "neg": count_true(~is_positive)}
    )


def auc(
    df: DataFrame,
    keys: Sequence[str] = FIT,
    truth: str = "truth",
    score: str = "score",
    positive: str = "detected",
    pieces: int | None = None,
) -> DataFrame:
    """Area under the ROC curve per fit, ties counted half; NULL when only one class is present."""
    counts = _score_counts(df, keys, truth, score, positive)
    below = running(counts, keys, score, sums={"_neg_through": F.col("neg")}, pieces=pieces, weigh=df)
    wins = F.col("pos") * (F.col("_neg_through") - F.col("neg") / F.lit(2.0))
    summed = below.groupBy(*keys).agg(F.sum(wins).alias("_w"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    pairs = F.col("_p").cast("double") * F.col("_n")
    return summed.select(*keys, F.when(pairs > 0, F.col("_w") / pairs).alias("auc"))


def roc_curve(
    df: DataFrame,
    keys: Sequence[str] = FIT,
    truth: str = "truth",
    score: str = "score",
    positive: str = "detected",
    min_threshold: float | None = None,
    endpoints: bool = True,
    pieces: int | None = None,
) -> DataFrame:
    """(keys, threshold, sensitivity, specificity): one point per distinct score, predicted positive at or
    above it; with ``endpoints`` also minus and plus infinity. ``min_threshold`` keeps larger thresholds only.
    """
    counts = _score_counts(df, keys, truth, score, positive)
    cumulative = running(
        counts, keys, score,
        sums={"_tp": F.col("pos"), "_fp": F.col("neg")}, totals={"_p": F.col("pos"), "_n": F.col("neg")},
        descending=True, pieces=pieces, weigh=df,
    )
    curve = cumulative.select(
        *keys,
        F.col(score).cast("double").alias("threshold"),
        F.try_divide(F.col("_tp"), F.col("_p")).alias("sensitivity"),
        (1 - F.try_divide(F.col("_fp"), F.col("_n"))).alias("specificity"),
    )
    if endpoints:
        ends = counts.groupBy(*keys).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
        ends = expand_grid(ends, threshold=[float("-inf"), float("inf")])
        low = F.col("threshold") < 0
        curve = curve.unionByName(
            ends.select(
                *keys, "threshold",
                F.when(F.col("_p") > 0, F.when(low, 1.0).otherwise(0.0)).alias("sensitivity"),
                F.when(F.col("_n") > 0, F.when(low, 0.0).otherwise(1.0)).alias("specificity"),
            )
        )
    return curve if min_threshold is None else curve.filter(F.col("threshold") > min_threshold)


def sens_spec_lookup(
    df: DataFrame,
    keys: Sequence[str] = FIT,
    row_id: str = "row_id",
    truth: str = "truth",
    score: str = "score",
    positive: str = "detected",
    pieces: int | None = None,
) -> DataFrame:
    """Sensitivity, specificity and false-positive rate after each single row, best score first."""
    is_positive = (F.col(truth) == F.lit(positive)).cast("bigint")
    steps = running(
        df.filter(F.col(truth).isNotNull()), keys, score, [row_id],
        sums={"_tp": is_positive, "_fp": 1 - is_positive}, totals={"_p": is_positive, "_n": 1 - is_positive},
        descending=True, pieces=pieces,
    )
    fpr = F.try_divide(F.col("_fp"), F.col("_n"))
    return steps.select(
        *keys, row_id,
        F.try_divide(F.col("_tp"), F.col("_p")).alias("sensitivity"), (1 - fpr).alias("specificity"), fpr.alias("fpr"),
    )


def sensitivity_at(lookup: DataFrame, keys: Sequence[str], specificities: Sequence[float]) -> DataFrame:
    """Best sensitivity among points with at least the given specificity, for each of them.

    Points are first reduced to the best sensitivity per requested level they still satisfy.
    """
    wanted = F.array(*[F.lit(float(s)) for s in specificities])
    met = F.filter(wanted, lambda s: s <= F.col("specificity"))
    reached = lookup.select(*keys, "sensitivity", F.explode(met).alias("at"))
    best = reached.groupBy(*keys, "at").agg(F.max("sensitivity").alias("sensitivity"))
    return best.select(*keys, F.col("at").alias("specificity"), "sensitivity", (1 - F.col("at")).alias("fpr"))


def accuracy_table(
    df: DataFrame,
    keys: Sequence[str] = FIT,
    truth: str = "truth",
    score: str = "score",
    positive: str = "detected",
    threshold: float = 0.5,
) -> DataFrame:
    """Accuracy, sensitivity, specificity and Brier score per fit at a score threshold."""
    is_positive = F.col(truth) == F.lit(positive)
    called = F.col(score) >= threshold
    correct = (called == is_positive).cast("int")
    return df.filter(F.col(truth).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(correct).alias("accuracy"),
        F.avg(F.when(is_positive, correct)).alias("sensitivity"),
        F.avg(F.when(~is_positive, correct)).alias("specificity"),
        F.avg(F.pow(F.col(score) - is_positive.cast("int"), 2.0)).alias("brier"),
    )


def auc_summary(
    aucs: DataFrame,
    probabilities: Mapping[str, float] | None = None,
    labels: Mapping[str, str] | None = None,
    digits: int = 3,
) -> DataFrame:
    """Median and bounds of the AUC over imputations, with a display label per model."""
    probabilities = probabilities or {"min": 0.025, "auc": 0.5, "max": 0.975}
    renamed = aucs.withColumnRenamed("auc", "_auc")
    table = renamed.groupBy("model").agg(*small_group_quantiles("_auc", probabilities))
    rounded = table.select("model", *[F.round(n, digits).alias(n) for n in probabilities])
    return rounded.withColumn("location", recode("model", labels or {}))


def model_type(model: str = "model", year_suffix: str = "_2024") -> Column:
    """Was the model tested on a held-out year or on a held-out location?"""
    suffix = year_suffix.lstrip("_")
    return F.when(F.col(model).endswith(year_suffix), f"Tested on {suffix}").otherwise("Tested on Location")


def roc_bands(
    curve: DataFrame,
    probabilities: Mapping[str, float] | None = None,
    year_suffix: str = "_2024",
    pieces: int | None = None,
) -> DataFrame:
    """Median sensitivity and quartiles over imputations per (model, specificity), forced to fall.

    Averaging over imputations can break the monotone relation; a running minimum restores it.
    """
    probabilities = probabilities or {"lower": 0.25, "upper": 0.75, "sensitivity": 0.5}
    complete = cut(curve.filter(F.col("specificity").isNotNull()))
    medians = group_quantiles(complete, ["model", "imp", "specificity"], "sensitivity", {"_m": 0.5}, pieces)
    bands = medians.groupBy("model", "specificity").agg(*small_group_quantiles("_m", probabilities))
    falling = running(
        bands.withColumnsRenamed({n: f"_{n}" for n in probabilities}), ["model"], "specificity",
        mins={n: F.col(f"_{n}") for n in probabilities}, pieces=pieces,
    )
    return falling.select("model", "specificity", *probabilities, model_type("model", year_suffix).alias("model_type"))
