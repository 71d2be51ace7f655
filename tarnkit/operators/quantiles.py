"""Exact medians, quantiles and midranks of groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnkit.operators.ordering import running


def value_counts(
    df: DataFrame, keys: Sequence[str], value: str, counts: Mapping[str, Column] | None = None
) -> DataFrame:
    """Rows per (keys, value), NULL values left out; combined before the shuffle."""
    counts = counts or {"n": F.count(F.lit(1))}
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(*[c.alias(n) for n, c in counts.items()])


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    pieces: int | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles per group, one column per entry of ``probabilities``.

    ``percentile`` keeps every distinct value of a group in one task. This walks cumulative counts of
    distinct values instead, so a group may be larger than an executor. Groups with no value are absent.
    """
    keys = list(keys)
    cumulative = running(
        value_counts(df, keys, value), keys, value, sums={"_through": F.col("n")}, totals={"_all": F.col("n")},
        pieces=pieces, weigh=df,
    )
    picks = {}
    for name, p in probabilities.items():
        at = (F.col("_all") - 1) * F.lit(float(p))
        for side, index in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (F.col("_through") > index) & (F.col("_through") - F.col("n") <= index)
            picks[f"_{side}_{name}"] = F.max(F.when(here, F.col(value).cast("double")))
    picked = cumulative.groupBy(*keys).agg(
        F.max("_all").alias("_all"), *[c.alias(n) for n, c in picks.items()]
    )

    def between(name: str, p: float) -> Column:
        at = (F.col("_all") - 1) * F.lit(float(p))
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        share = at - F.floor(at)
        return (low * (1 - share) + high * share).alias(name)

    return picked.select(*keys, *[between(n, p) for n, p in probabilities.items()])


def small_group_quantiles(value: str, probabilities: Mapping[str, float]) -> list[Column]:
    """The same quantiles as aggregates, for groups whose size is bounded by design (draws, imputations)."""
    return [F.percentile(value, float(p)).alias(name) for name, p in probabilities.items()]


def value_midranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    counts: Mapping[str, Column] | None = None,
    pieces: int | None = None,
) -> DataFrame:
    """One row per (keys, value): ``n``, any further counts, ``midrank`` and the group total ``total``."""
    counts = {"n": F.count(F.lit(1)), **(counts or {})}
    cumulative = running(
        value_counts(df, keys, value, counts), keys, value,
        sums={"_through": F.col("n")}, totals={"total": F.col("n")}, pieces=pieces, weigh=df,
    )
    midrank = F.col("_through") - (F.col("n") - 1) / F.lit(2.0)
    return cumulative.withColumn("midrank", midrank).drop("_through")
