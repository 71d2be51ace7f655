"""Detection tables: rates, sites with detections, and detections paired between sampling methods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnkit.functions.censoring import detected
from tarnkit.functions.semantics import count_true, paste
from tarnkit.operators.timeseries import lags


def detection_summary(
    df: DataFrame, keys: Sequence[str], value: str, limit: str, inclusive: bool = False
) -> DataFrame:
    """Samples taken, samples detected, rate and a ``"k / n"`` label per group; missing samples left out."""
    hits = count_true(detected(value, limit, inclusive))
    summary = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), hits.alias("n_detections"),
        F.avg(detected(value, limit, inclusive).cast("int")).alias("detection_rate"),
    )
    return summary.withColumn("label", paste("n_detections", F.lit("/"), "n", sep=" "))


def groups_with_detections(
    df: DataFrame, keys: Sequence[str], value: str, limit: str, at_least: int = 1, inclusive: bool = False
) -> DataFrame:
    """Groups with a minimum number of detections, and how many they have."""
    counted = df.groupBy(*keys).agg(count_true(detected(value, limit, inclusive)).alias("n_detections"))
    return counted.filter(F.col("n_detections") >= at_least)


def paired_detections(
    df: DataFrame,
    keys: Sequence[str],
    date: str,
    event: tuple[str, str],
    other: tuple[str, str],
    pieces: int | None = None,
) -> DataFrame:
    """For each detection by one method: did the other detect in the same, previous or second-previous sample?

    ``event`` and ``other`` are (value, limit) columns of a table with one row per (keys, date). Both methods
    sit on the same row, so nothing is joined; the previous samples are lags within ``keys``.
    """
    flagged = df.select(
        *keys, date, detected(*event).alias("_event"), detected(*other).cast("int").alias("_same")
    )
    looked_back = lags(flagged, keys, date, {"_prev": ("_same", 1), "_prev2": ("_same", 2)}, pieces=pieces)
    hits = looked_back.filter(F.col("_event"))
    return hits.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_detects"),
        F.coalesce(F.sum("_same"), F.lit(0)).alias("same_week"),
        F.coalesce(F.sum("_prev"), F.lit(0)).alias("prev_week"),
        F.coalesce(F.sum("_prev2"), F.lit(0)).alias("two_weeks"),
    )
