"""Pearson correlation of column pairs and Spearman correlation of group summaries."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnkit.functions.censoring import detected
from tarnkit.functions.tails import t_p
from tarnkit.operators.joins import equi_join
from tarnkit.operators.ordering import midranks
from tarnkit.operators.quantiles import group_quantiles
from tarnkit.operators.reshape import longer
from tarnkit.session import cut


def pearson(x, y) -> Column:
    """Aggregate: Pearson r over complete pairs; NULL for fewer than two pairs or a constant side."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    spread = F.sqrt(F.var_pop(F.when(both, x)) * F.var_pop(F.when(both, y)))
    return F.when(spread > 0, F.try_divide(F.covar_pop(x, y), spread))


def column_pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    """Unordered pairs of different columns, each once."""
    return list(combinations(columns, 2))


def pair_grid(df: DataFrame, columns: Sequence[str], per: int = 150) -> DataFrame:
    """(var, var2, n): every pair of columns with its number of complete rows; one scan per block of pairs."""

    def count(a: str, b: str) -> list[Column]:
        return [F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias("n")]

    return _over_pairs(df, columns, count, per)


def _over_pairs(df: DataFrame, columns: Sequence[str], aggregates, per: int) -> DataFrame:
    pairs, result = column_pairs(columns), None
    for start in range(0, len(pairs), per):
        block = pairs[start : start + per]
        cells = [F.struct(F.lit(a).alias("var"), F.lit(b).alias("var2"), *aggregates(a, b)) for a, b in block]
        part = df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
        result = part if result is None else result.unionByName(part)
    return result


def pearson_pairs(df: DataFrame, columns: Sequence[str], per: int = 150, p_values: bool = True) -> DataFrame:
    """All-pairs Pearson r with t and two-sided p: (var, var2, n, correlation, t, p_value).

    One aggregation computes a block of pairs; nothing is shuffled but one row per task.
    """

    def moments(a: str, b: str) -> list[Column]:
        complete = F.col(a).isNotNull() & F.col(b).isNotNull()
        return [F.count(F.when(complete, 1)).alias("n"), pearson(a, b).alias("correlation")]

    pairs = _over_pairs(df, columns, moments, per)
    r, freedom = F.col("correlation"), F.col("n") - 2
    rest = F.lit(1.0) - r * r
    t = F.when(freedom > 0, F.when(rest > 0, r * F.sqrt(freedom / rest)).otherwise(r * F.lit(float("inf"))))
    pairs = pairs.withColumn("t", t)
    return pairs.withColumn("p_value", t_p("t", freedom.cast("double"))) if p_values else pairs


def spearman(
    df: DataFrame, keys: Sequence[str], x: str, y: str, pieces: int | None = None, stored: bool = False
) -> DataFrame:
    """Spearman correlation per group of ``keys``; NULL as soon as one value is missing.

    The table is read several times; say ``stored`` if it already is a stored table.
    """
    df = df.select(*keys, x, y)
    df = df if stored else cut(df)
    ranked = midranks(midranks(df, keys, x, "_rx", pieces), keys, y, "_ry", pieces)
    complete = F.count(F.when(F.col(x).isNull() | F.col(y).isNull(), 1)) == 0
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.when(complete, pearson("_rx", "_ry")).alias("spearman")
    )


def detection_correlation(
    df: DataFrame,
    group: str,
    columns: Sequence[str],
    value: str,
    limit: str,
    pieces: int | None = None,
) -> DataFrame:
    """Spearman correlation between group medians of each column and the group detection rate.

    Samples without a measured ``value`` are left out. Result: (name, n, spearman), n counting groups.
    """
    sampled = df.filter(F.col(value).isNotNull())
    rates = sampled.groupBy(group).agg(F.avg(detected(value, limit).cast("int")).alias("detection_rate"))
    long = longer(sampled.select(group, *[F.col(c).cast("double").alias(c) for c in columns]), [group], columns)
    medians = group_quantiles(long, [group, "name"], "value", {"median": 0.5}, pieces)
    wanted = rates.withColumn("name", F.explode(F.array(*[F.lit(c) for c in columns])))
    joined = equi_join(wanted, medians, [group, "name"], "left")
    return spearman(joined, ["name"], "median", "detection_rate", pieces)
