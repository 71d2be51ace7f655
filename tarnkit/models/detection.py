"""Detection probability by site and year: ridge logistic regression with bootstrap draws."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Interaction, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnkit.models.forest import in_flight
from tarnkit.operators.joins import small_side


def poisson_weight(key: str, seed: int | Column) -> Column:
    """Bootstrap weight: a Poisson(1) number from a seeded hash of the row key, repeatable on any executor."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    uniform = F.pmod(F.xxhash64(F.col(key), seed), F.lit(1 << 52)) / F.lit(float(1 << 52))
    reached, term, steps = 0.0, math.exp(-1), []
    for n in range(1, 16):
        reached += term
        term /= n
        steps.append(F.when(uniform >= reached, 1.0).otherwise(0.0))
    total = steps[0]
    for step in steps[1:]:
        total = total + step
    return total


def with_season(df: DataFrame, week: str, weeks_per_year: float = 52.1775) -> DataFrame:
    """Two harmonics of the week of the year."""
    angle = F.col(week) * F.lit(2 * math.pi / weeks_per_year)
    return df.withColumns({"_sin1": F.sin(angle), "_cos1": F.cos(angle), "_sin2": F.sin(2 * angle), "_cos2": F.cos(2 * angle)})


def detection_pipeline(location: str, year: str, x: str, ridge: float) -> Pipeline:
    """Location and year effects, season, slope of ``x`` and its deviation by location."""
    return Pipeline(stages=[
        StringIndexer(inputCols=[location, year], outputCols=["_l", "_y"], handleInvalid="keep"),
        OneHotEncoder(inputCols=["_l", "_y"], outputCols=["_lv", "_yv"], dropLast=False),
        Interaction(inputCols=[x, "_lv"], outputCol="_slopes"),
        VectorAssembler(
            inputCols=["_lv", "_yv", "_sin1", "_cos1", "_sin2", "_cos2", x, "_slopes"], outputCol="_features"
        ),
        LogisticRegression(
            featuresCol="_features", labelCol="_label", weightCol="_weight", probabilityCol="_probability",
            regParam=ridge, elasticNetParam=0.0, standardization=False, maxIter=50,
        ),
    ])


def bootstrap_models(
    df: DataFrame, key: str, label: Column, location: str, year: str, week: str, x: str,
    replicates: int, ridge: float = 0.01, seed: int = 1543, at_once: int = 4,
) -> list[PipelineModel]:
    """One fitted pipeline per bootstrap replicate of the rows with a known outcome and ``x``; ``at_once`` are fitted side by side."""
    rows = with_season(df, week).withColumn("_label", label.cast("double"))
    rows = rows.filter(F.col("_label").isNotNull() & F.col(x).isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)
    pipeline = detection_pipeline(location, year, x, ridge)
    try:
        fit = lambda b: pipeline.copy().fit(rows.withColumn("_weight", poisson_weight(key, seed + b)))
        return in_flight(range(replicates), fit, at_once)
    finally:
        rows.unpersist()


COEFFICIENT_ROWS = 1_000_000  # rows of a few numbers, well under 200 MB
_SEASON = ("sin1", "cos1", "sin2", "cos2")


def coefficient_tables(spark: SparkSession, models: Sequence[PipelineModel]) -> tuple[DataFrame, DataFrame]:
    """The replicates' coefficients as tables: (draw, location, base, slope, season terms) and (draw, year, effect).

    Their size is the number of model parameters, which the fitted models already hold on the driver.
    """
    by_location, by_year = [], []
    for draw, model in enumerate(models, 1):
        locations, years = model.stages[0].labelsArray
        weights, intercept = model.stages[-1].coefficients.toArray(), float(model.stages[-1].intercept)
        n, m = len(locations) + 1, len(years) + 1  # one slot each for unseen labels
        if len(weights) != 2 * n + m + 5:
            raise ValueError("the pipeline does not have the expected layout")
        season = [float(w) for w in weights[n + m : n + m + 4]]
        common, deviations = float(weights[n + m + 4]), weights[n + m + 5 :]
        for i, name in enumerate(locations):
            by_location.append((draw, name, intercept + float(weights[i]), common + float(deviations[i]), *season))
        by_year += [(draw, name, float(weights[n + j])) for j, name in enumerate(years)]
    terms = ", ".join(f"_b_{t} double" for t in _SEASON)
    return (
        spark.createDataFrame(by_location, f"draw int, _location string, _base double, _slope double, {terms}"),
        spark.createDataFrame(by_year, "_draw int, _year string, _effect double"),
    )


def draws_on_grid(
    models: Sequence[PipelineModel], grid: DataFrame, location: str, year: str, week: str, x: str
) -> DataFrame:
    """The draws table (location, year, week, draw, x, p): all replicates evaluated on the whole grid.

    The grid is joined with the coefficients, so thousands of replicates are one plan of two small-side joins
    and an expression. Every cell of the grid has its draws: p is NULL where the location or the year was never fitted.
    """
    by_location, by_year = coefficient_tables(grid.sparkSession, models)
    numbers = F.explode(F.sequence(F.lit(1), F.lit(len(models))))
    cells = with_season(grid, week)
    cells = cells.withColumn("_number", numbers)
    by_location = by_location.withColumnRenamed("draw", "_of")
    same_location = (F.col(location).cast("string") == F.col("_location")) & (F.col("_number") == F.col("_of"))
    cells = cells.join(small_side(by_location, COEFFICIENT_ROWS), same_location, "left").withColumnRenamed("_number", "draw")
    same_year = (F.col(year).cast("string") == F.col("_year")) & (F.col("draw") == F.col("_draw"))
    cells = cells.join(small_side(by_year, COEFFICIENT_ROWS), same_year, "left")
    logit = F.col("_base") + F.col("_effect") + F.col("_slope") * F.col(x)
    for term in _SEASON:
        logit = logit + F.col(f"_b_{term}") * F.col(f"_{term}")
    return cells.select(
        F.col(location).alias("location"), F.col(year).alias("year"), F.col(week).alias("week"), "draw",
        F.col(x).alias("x"), (1 / (1 + F.exp(-logit))).alias("p"),
    )
