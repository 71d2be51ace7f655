"""Centre-and-scale with kept constants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnkit.functions.semantics import divide
from tarnkit.operators.joins import lookup_join


def scaling_constants(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and standard deviation per column, long form (by, name, center, scale); one scan."""
    stats = [s for c in columns for s in (F.avg(c).alias(f"_c_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))]
    entries = [
        F.struct(F.lit(c).alias("name"), F.col(f"_c_{c}").alias("center"), F.col(f"_s_{c}").alias("scale"))
        for c in columns
    ]
    return df.groupBy(*by).agg(*stats).select(*by, F.inline(F.array(*entries)))


def _constant(constants: DataFrame, name: str) -> Column:
    """One column's constants as a scalar subquery."""
    return constants.filter(F.col("name") == name).agg(
        F.first(F.struct("center", "scale"))
    ).scalar()


def scale(value: Column, center, spread) -> Column:
    return divide(value - center, spread)


def unscale(value: Column, center, spread) -> Column:
    return value * spread + center


def zscores(df: DataFrame, columns: Sequence[str], prefix: str = "s_", by: Sequence[str] = ()) -> DataFrame:
    """Add z-scores over the whole table, or per group."""
    stats = [
        F.struct(F.avg(c).alias("center"), F.stddev_samp(c).alias("scale")).alias(f"_k_{c}") for c in columns
    ]
    if by:
        joined = lookup_join(df, df.groupBy(*by).agg(*stats), by, "left", null_safe=True, derived=True)
    else:
        whole = df.agg(*stats).select(F.struct(*[f"_k_{c}" for c in columns])).scalar()
        joined = df.withColumn("_k", whole).select("*", "_k.*").drop("_k")
    scaled = {f"{prefix}{c}": scale(F.col(c), F.col(f"_k_{c}.center"), F.col(f"_k_{c}.scale")) for c in columns}
    return joined.withColumns(scaled).drop(*[f"_k_{c}" for c in columns])


def apply_scaling(df: DataFrame, column: str, constants: DataFrame, name: str, output: str) -> DataFrame:
    """Scale new values with constants kept from another table."""
    k = _constant(constants, name)
    return df.withColumn("_k", k).withColumn(
        output, scale(F.col(column), F.col("_k.center"), F.col("_k.scale"))
    ).drop("_k")


def undo_scaling(df: DataFrame, column: str, constants: DataFrame, name: str, output: str) -> DataFrame:
    """Back to original units."""
    k = _constant(constants, name)
    return df.withColumn("_k", k).withColumn(
        output, unscale(F.col(column), F.col("_k.center"), F.col("_k.scale"))
    ).drop("_k")
