"""Rank tests between groups, per variable, with ties and multiple-comparison correction.

Everything is computed from counts per (variable, value, group): the table is shuffled once in that reduced
form, ranks come from cumulative counts over pieces of the value range, and from there on there is one row
per (variable, group).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnkit.functions.tails import chi2_p, normal_p
from tarnkit.operators.joins import equi_join, lookup_join, small_side
from tarnkit.operators.ordering import running
from tarnkit.operators.quantiles import value_counts
from tarnkit.session import cut


def rank_sums(
    df: DataFrame, variable: str = "name", value: str = "value", group: str = "location", pieces: int | None = None
) -> DataFrame:
    """(variable, group): ``n``, ``rank_sum`` and the group's share ``ties`` of the tie term sum(t^3 - t)."""
    grouped = F.count(F.when(F.col(group).isNotNull(), 1))
    counts = value_counts(df, [variable, group], value, {"n": grouped})
    ranked = running(
        counts, [variable], value, sums={"_through": F.col("n")}, peers={"_t": F.col("n")}, pieces=pieces, weigh=df
    ).filter(F.col("n") > 0)
    t = F.col("_t").cast("double")
    midrank = F.col("_through") - (t - 1) / 2
    return ranked.groupBy(variable, group).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * midrank).alias("rank_sum"),
        F.sum(F.col("n") * (t * t - 1)).alias("ties"),
    )


def kruskal_wallis(
    df: DataFrame, variable: str = "name", value: str = "value", group: str = "location", pieces: int | None = None
) -> DataFrame:
    """Tie-corrected Kruskal-Wallis test per variable: (variable, statistic, df, p_value)."""
    sums = rank_sums(df, variable, value, group, pieces)
    per_variable = sums.groupBy(variable).agg(
        F.sum("n").cast("double").alias("n"),
        F.count(F.lit(1)).alias("groups"),
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("squares"),
        F.sum("ties").alias("ties"),
    )
    n = F.col("n")
    raw = F.lit(12.0) / (n * (n + 1)) * F.col("squares") - 3 * (n + 1)
    correction = 1 - F.col("ties") / (n * n * n - n)
    statistic = F.when((n > 1) & (F.col("groups") > 1) & (correction > 0), raw / correction)
    tested = per_variable.select(
        variable, statistic.alias("statistic"), (F.col("groups") - 1).cast("int").alias("df")
    )
    return tested.withColumn("p_value", chi2_p("statistic", F.col("df").cast("double")))


def dunn_pairs(
    df: DataFrame,
    variable: str = "name",
    value: str = "value",
    group: str = "location",
    alternative: str = "one_sided",
    pieces: int | None = None,
) -> DataFrame:
    """Dunn's z for every pair of groups of a variable, with p and Benjamini-Hochberg adjusted p.

    A pair appears once, in group order. ``alternative`` chooses the upper tail of |z| or twice that.
    """
    if alternative not in ("one_sided", "two_sided"):
        raise ValueError("alternative must be one_sided or two_sided")
    sums = cut(rank_sums(df, variable, value, group, pieces))
    whole = sums.groupBy(variable).agg(F.sum("n").cast("double").alias("_N"), F.sum("ties").alias("_T"))
    mean_ranks = sums.select(
        variable, F.col(group).alias("group_1"), F.col("n").alias("_n1"), (F.col("rank_sum") / F.col("n")).alias("_m1")
    )
    others = mean_ranks.withColumnsRenamed({"group_1": "group_2", "_n1": "_n2", "_m1": "_m2"})
    pairs = mean_ranks.join(small_side(others), variable).filter(F.col("group_1") < F.col("group_2"))
    pairs = equi_join(pairs, small_side(whole), variable, "inner")
    n = F.col("_N")
    variance = (n * (n + 1) / 12 - F.col("_T") / (12 * (n - 1))) * (F.lit(1.0) / F.col("_n1") + F.lit(1.0) / F.col("_n2"))
    z = F.when((n > 1) & (variance > 0), (F.col("_m1") - F.col("_m2")) / F.sqrt(variance))
    scored = pairs.select(variable, "group_1", "group_2", z.alias("z"))
    tails = 2.0 if alternative == "two_sided" else 1.0
    tested = scored.withColumn("p_value", normal_p(F.abs("z")) * tails)
    return adjust_bh(tested, [variable], "p_value")


def adjust_bh(
    df: DataFrame,
    keys: Sequence[str],
    p: str = "p_value",
    name: str = "p_adjusted",
    pieces: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """Benjamini-Hochberg step-up adjustment within groups; NULL p-values do not count.

    Equal p-values share the largest of their ranks, so ranks and running minimum are taken on counts per p-value, where a
    value that many tests share is one row, and joined back. The table of tests is read several times; say ``stored`` if
    it already is a stored table.
    """
    df, keys = df if stored else cut(df), list(keys)
    counts = cut(df.filter(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count(F.lit(1)).alias("_n")))
    ranked = running(counts, keys, p, sums={"_rank": F.col("_n")}, totals={"_m": F.col("_n")}, pieces=pieces)
    raised = ranked.withColumn("_q", F.col(p) * F.col("_m") / F.col("_rank"))
    stepped = running(raised, keys, p, mins={"_best": F.col("_q")}, descending=True, pieces=pieces)
    adjusted = stepped.select(*keys, p, F.least(F.lit(1.0), F.col("_best")).alias(name))
    return lookup_join(df, adjusted, [*keys, p], "left", null_safe=keys, derived=True)


def significant(df: DataFrame, p: str = "p_adjusted", level: float = 0.05) -> DataFrame:
    """Rows with p below the level (unrounded), with ``neglog_p``."""
    return df.filter(F.col(p) < level).withColumn("neglog_p", -F.log10(F.greatest(F.col(p), F.lit(5e-324))))
