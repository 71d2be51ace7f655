"""Missingness, keys, repeated samples and ordered domains."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnkit.functions.semantics import as_col, level_order, recode
from tarnkit.operators.ordering import positions
from tarnkit.operators.selectors import column_names, contains


def missing_fraction(df: DataFrame, columns: Sequence[str], per: int = 500) -> DataFrame:
    """Share of missing values per column, long form (name, prop_missing); one scan of the table.

    Wide tables are aggregated in blocks of columns so that generated code stays small.
    """
    blocks = [columns[i : i + per] for i in range(0, len(columns), per)]
    result = None
    for block in blocks:
        shares = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(c) for c in block])
        part = shares.unpivot([], [f"`{c}`" for c in block], "name", "prop_missing")
        result = part if result is None else result.unionByName(part)
    return result


def sparse_columns(
    df: DataFrame, columns: Sequence[str], threshold: float = 0.4, exempt: str | None = None
) -> list[str]:
    """Columns missing more often than the threshold, except names matching ``exempt``."""
    found = missing_fraction(df, columns).filter(F.col("prop_missing") > threshold)
    if exempt:
        found = found.filter(~F.col("name").rlike(exempt))
    return [row["name"] for row in found.collect()]


def drop_sparse_columns(
    df: DataFrame, columns: Sequence[str], threshold: float = 0.4, exempt: str | None = None
) -> DataFrame:
    """Drop every column whose name contains the name of a sparse column (its limits go with it)."""
    sparse = sparse_columns(df, columns, threshold, exempt)
    return df.drop(*column_names(df, contains(*sparse))) if sparse else df


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def verify_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Return the table unchanged, or raise when the keys do not identify a row."""
    broken = key_violations(df, keys).limit(3).collect()
    if broken:
        raise ValueError(f"{list(keys)} repeated, for example {[tuple(r) for r in broken]}")
    return df


def one_per_period(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keep the maximum of repeated measurements per key."""
    return df.groupBy(*keys).agg(*[F.max(v).alias(v) for v in values])


def fill_nulls(df: DataFrame, constants: Mapping[str, object]) -> DataFrame:
    """Replace NULL by a constant, column by column."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in constants.items()})


def prefer(first, second) -> Column:
    """The first measurement, or the second where the first is missing."""
    return F.coalesce(as_col(first), as_col(second))


def recode_column(df: DataFrame, column: str, labels: Mapping) -> DataFrame:
    """Replace the labels of a column by a dictionary; others keep their own."""
    return df.withColumn(column, recode(column, labels))


def ordered_levels(df: DataFrame, column: str, levels: Sequence, name: str = "ord") -> DataFrame:
    """Add the position of each value in an ordered domain; values outside it get NULL."""
    return df.withColumn(name, level_order(column, list(levels)))


def level_rank(df: DataFrame, level: str, by: str, name: str = "ord") -> DataFrame:
    """Order levels by an aggregate: position of each level, ties broken by the level itself.

    The table holds one row per level.
    """
    return positions(df, [], by, [level], name).withColumn(name, F.col(name).cast("int"))
