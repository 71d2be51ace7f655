"""Three-valued logic, division, missing values and recoding with the rules of a statistics language.

Spark differs in a few places that silently change results: ``otherwise`` also catches NULL conditions,
ANSI division raises on zero, NaN sorts and compares as the largest number, and ``sum`` of nothing is NULL.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_col(value) -> Column:
    """A column from a name or a column."""
    return F.col(value) if isinstance(value, str) else value


def if_else3(condition: Column, yes, no) -> Column:
    """``yes`` where true, ``no`` where false, NULL where the condition is NULL."""
    return F.when(condition, yes).when(~condition, no)


def none_if_nan(column) -> Column:
    """NaN becomes NULL, so that comparisons and medians skip it."""
    column = as_col(column)
    return F.when(~F.isnan(column), column)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Apply :func:`none_if_nan` to every floating column of a table."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({name: none_if_nan(F.col(f"`{name}`")) for name in floating}) if floating else df


def divide(numerator, denominator) -> Column:
    """Division where x/0 is signed infinity and 0/0 is missing."""
    n = as_col(numerator).cast("double")
    d = as_col(denominator).cast("double")
    by_zero = F.when(n > 0, F.lit(float("inf"))).when(n < 0, F.lit(float("-inf")))
    return F.when(d == 0, by_zero).otherwise(F.try_divide(n, d))


def log10(column) -> Column:
    """Base-10 logarithm; zero gives minus infinity and negative input is missing."""
    x = as_col(column).cast("double")
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(F.log10(x))


def sum0(column) -> Column:
    """Sum that ignores NULL and is zero over nothing."""
    return F.coalesce(F.sum(column), F.lit(0))


def count_true(condition: Column) -> Column:
    """Number of rows where a condition holds; NULL counts as not holding."""
    return F.count(F.when(condition, F.lit(1)))


def paste(*parts, sep: str = "") -> Column:
    """Concatenate with NULL printed as ``NA``."""
    return F.concat_ws(sep, *[F.coalesce(as_col(p).cast("string"), F.lit("NA")) for p in parts])


def interaction(*parts, sep: str = ".") -> Column:
    """Combined key; NULL if any part is NULL."""
    columns = [as_col(p).cast("string") for p in parts]
    joined = columns[0]
    for column in columns[1:]:
        joined = F.concat(joined, F.lit(sep), column)
    return joined


def recode(column, labels: Mapping) -> Column:
    """Replace values by a dictionary; values without an entry keep their own text."""
    column = as_col(column)
    if not labels:
        return column
    mapping = F.create_map(*[F.lit(v) for v in chain.from_iterable(labels.items())])
    return F.coalesce(F.try_element_at(mapping, column), column)


def level_order(column, levels: list) -> Column:
    """Position of a value in an ordered domain (from 1); NULL when it is not a level."""
    mapping = F.create_map(*[F.lit(v) for i, level in enumerate(levels, 1) for v in (level, i)])
    return F.try_element_at(mapping, as_col(column))


def keep_unless(*conditions: Column) -> Column:
    """Filter that drops a row only where a condition is definitely true."""
    keep = F.lit(True)
    for condition in conditions:
        keep = keep & ~F.coalesce(condition, F.lit(False))
    return keep


def in_order(df: DataFrame, **expressions: Column) -> DataFrame:
    """Add columns one after the other, so that a later one sees the earlier ones."""
    for name, expression in expressions.items():
        df = df.withColumn(name, expression)
    return df


def required(column: str) -> Column:
    """The column, and an error in the job where it is NULL."""
    return F.coalesce(F.col(column), F.raise_error(F.lit(f"{column} must not be NULL")))
