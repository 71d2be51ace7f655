"""Trailing windows, lags and autocorrelation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnkit.functions.semantics import required, sum0
from tarnkit.operators.ordering import trailing


def rolling(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    frames: Mapping[str, tuple[str, str, int]],
    ties: Sequence[str] = (),
    pieces: int | None = None,
) -> DataFrame:
    """Trailing statistics over the last k rows of each group; NULL until k rows exist.

    ``frames`` maps an output name to (statistic, column, k) with statistic ``sum`` or ``mean``. Missing
    values are skipped: a sum over nothing is zero and a mean over nothing is NULL.
    """

    def columns(window) -> dict[str, Column]:
        row = F.row_number().over(window)
        found = {}
        for name, (statistic, column, k) in frames.items():
            frame = window.rowsBetween(-(k - 1), Window.currentRow)
            total = F.coalesce(F.sum(column).over(frame), F.lit(0.0)) if statistic == "sum" else F.avg(column).over(frame)
            found[name] = F.when(row >= k, total)
        return found

    return trailing(df, keys, order, max(k for _, _, k in frames.values()), columns, ties, pieces)


def rolling_days(
    df: DataFrame, keys: Sequence[str], date: str, frames: Mapping[str, tuple[str, str, int]], block: int = 256
) -> DataFrame:
    """Trailing statistics over the last d calendar days, gaps and repeated dates included: one row per
    (keys, date).

    Days are summed before the shuffle and put into blocks; a day also enters the next block when a window
    there can reach it, so a window partition holds at most two blocks of days however long the series is.
    """
    reach = max(d for _, _, d in frames.values()) - 1
    if reach >= block:
        raise ValueError("the block must be longer than the longest window")
    columns = sorted({column for _, column, _ in frames.values()})
    parts = [a for c in columns for a in (F.sum(c).alias(f"_s_{c}"), F.count(c).alias(f"_n_{c}"))]
    daily = df.groupBy(*keys, F.col(date).cast("date").alias(date)).agg(*parts)
    daily = daily.withColumn("_day", F.unix_date(date))
    daily = daily.withColumn("_home", F.floor(F.col("_day") / block))
    spills = F.pmod(F.col("_day"), F.lit(block)) >= block - reach
    copies = F.when(spills, F.array(F.col("_home"), F.col("_home") + 1)).otherwise(F.array(F.col("_home")))
    window = Window.partitionBy(*keys, "_block").orderBy("_day")
    outputs = {}
    for name, (statistic, column, days) in frames.items():
        frame = window.rangeBetween(-(days - 1), 0)
        total = F.coalesce(F.sum(f"_s_{column}").over(frame), F.lit(0.0))
        count = F.sum(f"_n_{column}").over(frame)
        outputs[name] = total if statistic == "sum" else F.when(count > 0, total / count)
    placed = daily.withColumn("_block", F.explode(copies)).withColumns(outputs)
    return placed.filter(F.col("_block") == F.col("_home")).select(*keys, date, *outputs)


def lags(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: Mapping[str, tuple[str, int]],
    ties: Sequence[str] = (),
    pieces: int | None = None,
) -> DataFrame:
    """Earlier values within a group: output name to (column, steps back)."""
    return trailing(
        df, keys, order, max(k for _, k in columns.values()),
        lambda w: {name: F.lag(column, k).over(w) for name, (column, k) in columns.items()},
        ties, pieces,
    )


def autocorrelation(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    max_lag: int,
    ties: Sequence[str] = (),
    pieces: int | None = None,
) -> DataFrame:
    """Autocorrelation at lags 0..max_lag per group: (keys, lag, acf). A NULL value stops the job.

    The lagged products are summed in one aggregation; centring is done on the sums, after shifting all
    values by one constant to keep the cancellation small.
    """
    shift = df.agg(F.avg(value).alias("m")).first()["m"] or 0.0
    base = df.select(*keys, order, *ties, (required(value) - F.lit(shift)).alias("_x"))
    steps = range(1, max_lag + 1)
    shifted = lags(base, keys, order, {f"_l{k}": ("_x", k) for k in steps}, ties, pieces)
    sums = [F.count("_x").alias("_n"), F.sum("_x").alias("_s"), F.sum(F.col("_x") * F.col("_x")).alias("_q")]
    for k in steps:
        old = F.col(f"_l{k}")
        sums += [
            F.count(old).alias(f"_n{k}"),
            sum0(F.col("_x") * old).alias(f"_p{k}"),
            sum0(F.when(old.isNotNull(), F.col("_x"))).alias(f"_a{k}"),
            sum0(old).alias(f"_b{k}"),
        ]
    moments = shifted.groupBy(*keys).agg(*sums)
    mean = F.col("_s") / F.col("_n")
    spread = F.col("_q") - F.col("_n") * mean * mean
    entries = [F.struct(F.lit(0).alias("lag"), F.when(spread > 0, F.lit(1.0)).alias("acf"))]
    for k in steps:
        cross = F.col(f"_p{k}") - mean * (F.col(f"_a{k}") + F.col(f"_b{k}")) + F.col(f"_n{k}") * mean * mean
        entries.append(F.struct(F.lit(k).alias("lag"), F.when(spread > 0, cross / spread).alias("acf")))
    return moments.select(*keys, F.inline(F.array(*entries)))
