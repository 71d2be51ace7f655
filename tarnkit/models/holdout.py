"""Hold-out splits, class weights, folds and the choice of tuning parameters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnkit.operators.joins import lookup_join
from tarnkit.session import cut

ERROR_METRICS = ("rmse", "mae", "brier", "log_loss")


@dataclass(frozen=True)
class Holdout:
    """One split: rows whose ``column`` equals ``value`` are the test set."""

    name: str
    column: str
    value: object

    def train(self, df: DataFrame) -> DataFrame:
        return df.filter(F.col(self.column) != F.lit(self.value))

    def trains(self) -> Column:
        """Is a row a training row? False where the column is missing, as in ``train``."""
        return F.coalesce(F.col(self.column) != F.lit(self.value), F.lit(False))

    def test(self, df: DataFrame) -> DataFrame:
        return df.filter(F.col(self.column) == F.lit(self.value))


def split_sizes(df: DataFrame, columns: Sequence[str], prefix: str = "hold_") -> DataFrame:
    """(model, n_train, n_test) of holding out each value of each column, counted in one pass."""
    held = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("h"))
    sizes = cut(held.select("h.*").filter(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n_test")
    ))
    whole = sizes.groupBy("column").agg(F.sum("n_test").alias("_n"))
    joined = lookup_join(sizes, whole, "column", "inner")
    return joined.select(
        F.concat(F.lit(prefix), "value").alias("model"), (F.col("_n") - F.col("n_test")).alias("n_train"), "n_test"
    )


def class_weights(df: DataFrame, truth: str, keys: Sequence[str] = (), name: str = "weight") -> DataFrame:
    """Add weights that give the two classes half of the total weight each, per group of ``keys``."""
    per_class = df.filter(F.col(truth).isNotNull()).groupBy(*keys, truth).agg(F.count(F.lit(1)).alias("_n_class"))
    per_class = cut(per_class)
    if keys:
        whole = per_class.groupBy(*keys).agg(F.sum("_n_class").alias("_n"))
        per_class = lookup_join(per_class, whole, list(keys), "inner", null_safe=True)
    else:
        per_class = per_class.withColumn("_n", per_class.agg(F.sum("_n_class")).scalar())
    joined = lookup_join(df, per_class, [*keys, truth], "left", null_safe=list(keys))
    return joined.withColumn(name, 0.5 * F.col("_n") / F.col("_n_class")).drop("_n", "_n_class")


def add_fold(df: DataFrame, row_id: str, folds: int, seed: int, name: str = "fold") -> DataFrame:
    """Assign rows to folds by a seeded hash of their id: repeatable, and no shuffle."""
    return df.withColumn(name, F.pmod(F.xxhash64(F.col(row_id), F.lit(seed)), F.lit(folds)).cast("int"))


def even_levels(low: int, high: int, levels: int) -> list[int]:
    """Distinct whole numbers spread evenly over a range."""
    if levels < 2 or high <= low:
        return [low]
    return sorted({int(low + i * (high - low) / (levels - 1)) for i in range(levels)})


def regular_grid(n_features: int, levels: int = 5, min_n: tuple[int, int] = (2, 40)) -> list[tuple[int, int]]:
    """Regular grid of (mtry, min_n) with mtry from 1 to the number of features."""
    return [(m, n) for m in even_levels(1, n_features, levels) for n in even_levels(*min_n, levels)]


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """Average each metric over imputations, folds and repeats per parameter pair."""
    return metrics.groupBy("mtry", "min_n", "metric").agg(F.avg("value").alias("avg"))


def best_parameters(metrics: DataFrame, metric: str = "accuracy", digits: int = 9) -> DataFrame:
    """The one best (mtry, min_n): highest average, or lowest for error metrics; ties go to the smallest mtry,
    then the smallest min_n. Averages equal to ``digits`` places are ties.
    """
    averaged = mean_metrics(metrics).filter(F.col("metric") == metric)
    value = F.round("avg", digits)
    return averaged.orderBy(value.asc() if metric in ERROR_METRICS else value.desc(), "mtry", "min_n").limit(1)
