"""Grouped tables: medians and deviations, class counts, two-stage quantiles, top-n, cumulative columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnkit.functions.semantics import required
from tarnkit.operators.joins import equi_join, lookup_join
from tarnkit.operators.ordering import running
from tarnkit.operators.quantiles import group_quantiles, small_group_quantiles, value_counts
from tarnkit.operators.reshape import longer, wider


def across(columns: Sequence[str], functions: Mapping[str, Callable], name: str = "{stat}_{column}") -> list[Column]:
    """The same aggregates for many columns."""
    return [f(c).alias(name.format(stat=s, column=c)) for s, f in functions.items() for c in columns]


def median_sd(df: DataFrame, keys: Sequence[str], columns: Sequence[str], pieces: int | None = None) -> DataFrame:
    """Long table (keys, name, median, sd); a group without values keeps its row with NULLs."""
    long = longer(df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]), keys, columns)
    spread = long.groupBy(*keys, "name").agg(F.stddev_samp("value").alias("sd"))
    middle = group_quantiles(long, [*keys, "name"], "value", {"median": 0.5}, pieces)
    return equi_join(spread, middle, [*keys, "name"], "left", null_safe=True).select(*keys, "name", "median", "sd")


def chemistry_table(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], digits: int = 1, pieces: int | None = None
) -> DataFrame:
    """One row per group with ``median_<column>`` and ``sd_<column>``, rounded."""
    long = median_sd(df, keys, columns, pieces)
    firsts = {s: F.first(F.round(s, digits), ignorenulls=True) for s in ("median", "sd")}
    return wider(long, keys, "name", columns, firsts)


def class_counts(df: DataFrame, keys: Sequence[str], column: str, levels: Sequence) -> DataFrame:
    """One count column per class level."""
    return df.groupBy(*keys).agg(
        *[F.count(F.when(F.col(column) == F.lit(level), 1)).alias(f"n_{level}") for level in levels]
    )


def two_stage_quantiles(
    df: DataFrame,
    inner: Sequence[str],
    outer: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    pieces: int | None = None,
) -> DataFrame:
    """Median within (outer, inner), then quantiles of those medians within ``outer``."""
    first = group_quantiles(df, [*outer, *inner], value, {"_m": 0.5}, pieces)
    return first.groupBy(*outer).agg(*small_group_quantiles("_m", probabilities))


def percent_of_max(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Value as a percentage of the largest value of its group."""
    top = df.groupBy(*keys).agg(F.max(value).alias("_top"))
    joined = lookup_join(df, top, keys, "left", null_safe=True, derived=True)
    return joined.withColumn(name, F.try_divide(100 * F.col(value), F.col("_top"))).drop("_top")


def top_with_ties(
    df: DataFrame, keys: Sequence[str], value: str, n: int = 1, largest: bool = True
) -> DataFrame:
    """Rows holding the n largest (or smallest) values of each group; rows tied with the last one are kept.

    Only distinct values are ranked, at most n per group and task; the rows themselves are then compared
    with their group's threshold, so a group full of ties is not gathered anywhere.
    """
    column = F.col(value)
    order = column.desc() if largest else column.asc()
    window = Window.partitionBy(*keys).orderBy(order)
    best = value_counts(df, keys, value).withColumn("_r", F.row_number().over(window)).filter(F.col("_r") <= n)
    before = F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1))
    reached = best.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < n)
    edge = reached.groupBy(*keys).agg((F.min if largest else F.max)(value).alias("_edge"))
    rows = lookup_join(df, edge, keys, "inner", null_safe=True, derived=True) if keys else df.withColumn("_edge", edge.scalar())
    return rows.filter(column >= F.col("_edge") if largest else column <= F.col("_edge")).drop("_edge")


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each group in a total order; each task keeps one candidate per group before the shuffle."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_r") == 1).drop("_r")


def cumulative(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    ties: Sequence[str],
    value: str,
    pieces: int | None = None,
) -> DataFrame:
    """Cumulative sum, minimum and maximum and group count along an order; a NULL value stops the job."""
    return running(
        df, keys, order, ties,
        sums={"cum_sum": required(value)}, mins={"cum_min": F.col(value)}, maxs={"cum_max": F.col(value)},
        totals={"n_in_group": F.lit(1).cast("bigint")}, pieces=pieces,
    )


def rescale(df: DataFrame, value: str, outputs: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Map a column linearly from its own range to each given range; a constant column goes to the middle."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).select(F.struct("lo", "hi")).scalar()
    share = F.when(F.col("_e.hi") > F.col("_e.lo"), (F.col(value) - F.col("_e.lo")) / (F.col("_e.hi") - F.col("_e.lo")))
    share = F.when(F.col(value).isNotNull(), F.coalesce(share, F.lit(0.5)))
    scaled = {name: F.lit(float(a)) + share * F.lit(float(b - a)) for name, (a, b) in outputs.items()}
    return df.withColumn("_e", ends).withColumns(scaled).drop("_e")
