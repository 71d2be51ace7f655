"""Large tables of probability draws: prediction grids, thresholds, calibration and predictive checks.

A draws table is long: (location, year, week, draw, x, p). A curve is one (location, year, week, draw); its
size is the length of the x grid, fixed by design, while the number of curves grows with the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnkit.functions.dates import week_to_date
from tarnkit.operators.joins import even_steps, expand_grid
from tarnkit.operators.quantiles import small_group_quantiles
from tarnkit.session import shuffle_pieces

CURVE = ("location", "year", "week", "draw")
TARGETS = (0.5, 0.75, 0.95)
#: Points of curves that meet in one task.
POINTS_AT_ONCE = 500_000


def prediction_grid(
    df: DataFrame, keys: Sequence[str], axes: Mapping[str, tuple[str, int]]
) -> DataFrame:
    """Every (keys) combination present in the data, crossed with an even grid per axis.

    ``axes`` maps an output column to (input column, number of points); each axis spans the range of its
    input over the whole table.
    """
    ranges = df.agg(
        *[f(column).cast("double").alias(f"{end}_{name}")
          for name, (column, _) in axes.items() for end, f in (("lo", F.min), ("hi", F.max))]
    )
    ends = ranges.select(F.struct("*")).scalar()
    grid = df.select(*keys).distinct().withColumn("_e", ends)
    for name, (_, points) in axes.items():
        steps = even_steps(F.col(f"_e.lo_{name}"), F.col(f"_e.hi_{name}"), points)
        grid = expand_grid(grid, **{name: steps})
    return grid.drop("_e")


def mean_draws(draws: DataFrame, cell: Sequence[str] = ("location", "year", "week", "x"), p: str = "p") -> DataFrame:
    """Mean probability per grid cell over draws."""
    return draws.groupBy(*cell).agg(F.avg(p).alias("mean_p"))


def crossing_points(
    draws: DataFrame,
    curve: Sequence[str] = CURVE,
    x: str = "x",
    p: str = "p",
    targets: Sequence[float] = TARGETS,
    extrapolate: str = "clamp",
    points_at_once: int = POINTS_AT_ONCE,
) -> DataFrame:
    """x at which each curve reaches each target probability: (curve, probability, threshold).

    Equal p are merged by their mean x, and x is interpolated linearly in p between the nearest points on
    either side of the target. Outside the range of p the nearest end is taken (``clamp``) or NULL (``none``);
    a flat curve gives NULL. The neighbours are a maximum and a minimum, so nothing is sorted, and one shuffle
    by curve serves both aggregations. The points are counted first, so that a task gets about ``points_at_once`` of them
    and its memory does not grow with the table.
    """
    if extrapolate not in ("clamp", "none"):
        raise ValueError("extrapolate must be clamp or none")
    points = draws.filter(F.col(p).isNotNull()).select(*curve, F.col(x).alias("_x"), F.col(p).alias("_p"))
    parts = max(shuffle_pieces(draws.sparkSession), -(-draws.select(*curve).count() // points_at_once))
    merged = points.repartition(parts, *curve).groupBy(*curve, "_p").agg(F.avg("_x").alias("_m"))
    cells = []
    for i, target in enumerate(targets):
        below = F.when(F.col("_p") <= target, F.col("_p"))
        above = F.when(F.col("_p") >= target, F.col("_p"))
        cells += [
            F.max(below).alias(f"_p0_{i}"), F.max_by("_m", below).alias(f"_x0_{i}"),
            F.min(above).alias(f"_p1_{i}"), F.min_by("_m", above).alias(f"_x1_{i}"),
        ]
    ends = [
        F.min("_p").alias("_lo"), F.max("_p").alias("_hi"),
        F.min_by("_m", "_p").alias("_at_lo"), F.max_by("_m", "_p").alias("_at_hi"),
    ]
    curves = merged.groupBy(*curve).agg(*cells, *ends)
    entries = []
    for i, target in enumerate(targets):
        p0, p1, x0, x1 = (F.col(f"_{c}_{i}") for c in ("p0", "p1", "x0", "x1"))
        slope = F.try_divide(x1 - x0, p1 - p0)
        value = F.when(p0 == p1, x0).otherwise(x0 + (F.lit(float(target)) - p0) * slope)
        if extrapolate == "clamp":
            value = (
                F.when(F.col("_lo") > target, F.col("_at_lo")).when(F.col("_hi") < target, F.col("_at_hi"))
                .otherwise(value)
            )
        value = F.when(F.col("_lo") < F.col("_hi"), value)
        entries.append(F.struct(F.lit(float(target)).alias("probability"), value.alias("threshold")))
    return curves.select(*curve, F.inline(F.array(*entries)))


def threshold_summary(
    thresholds: DataFrame,
    keys: Sequence[str] = ("location", "year", "week", "probability"),
    start: str = "2023-01-01",
) -> DataFrame:
    """Median and quartiles over draws with the calendar date of the week; NULL thresholds are ignored."""
    summary = thresholds.groupBy(*keys).agg(
        *small_group_quantiles("threshold", {"median": 0.5, "q25": 0.25, "q75": 0.75})
    )
    return summary.withColumn("date", week_to_date("week", start))


def right_closed_bin(p: str, bins: int = 10) -> Column:
    """Number of the bin ((i-1)/bins, i/bins] holding p; zero falls outside and is NULL."""
    breaks = [i / bins for i in range(bins)]
    number = sum((F.when(F.col(p) > b, 1).otherwise(0) for b in breaks[1:]), F.lit(1))
    return F.when((F.col(p) > 0) & (F.col(p) <= 1), number)


def calibration(df: DataFrame, p: str, observed: Column, keys: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Mean observed outcome and mean predicted probability per right-closed bin of p."""
    binned = df.withColumn("bin", right_closed_bin(p, bins)).withColumn("_y", observed.cast("double"))
    return binned.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_y").alias("observed"), F.avg(p).alias("predicted")
    )


def grouped_checks(
    replicates: DataFrame, group: Sequence[str], draw: str, observed: str, replicated: str
) -> DataFrame:
    """Observed mean and sd of a binary outcome per group against their spread over replicated data sets.

    Rows are (draw, observation, group, observed, replicated). Each draw is first reduced to one row per group.
    """
    y, rep = F.col(observed).cast("double"), F.col(replicated).cast("double")
    per_draw = replicates.groupBy(*group, draw).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg(y).alias("_obs_mean"), F.stddev_samp(y).alias("_obs_sd"), F.sum(y).alias("_obs_count"),
        F.avg(rep).alias("_mean"), F.stddev_samp(rep).alias("_sd"), F.sum(rep).alias("_count"),
    )
    spread = [
        column
        for stat in ("mean", "sd", "count")
        for column in small_group_quantiles(
            f"_{stat}", {f"{stat}_low": 0.05, f"{stat}_median": 0.5, f"{stat}_high": 0.95}
        )
    ]
    return per_draw.groupBy(*group).agg(
        F.max("_n").alias("n"),
        F.max("_obs_mean").alias("observed_mean"),
        F.max("_obs_sd").alias("observed_sd"),
        F.max("_obs_count").alias("observed_count"),
        *spread,
    )


def residuals(
    predictions: DataFrame, keys: Sequence[str], observed: Column, p: str = "p"
) -> DataFrame:
    """Observed outcome minus the mean prediction over draws, per observation."""
    means = predictions.groupBy(*keys).agg(F.max(observed.cast("double")).alias("observed"), F.avg(p).alias("fitted"))
    return means.withColumn("residual", F.col("observed") - F.col("fitted"))
