"""Joins, lookups, grids and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnkit.session import cut

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Does the table hold at most ``rows`` rows and ``size`` bytes of text form? Stops reading after that many rows."""
    text = F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("size")
    found = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), text).first()
    return found["n"] <= rows and (found["size"] or 0) <= size


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a lookup that was just measured to be small; leave a larger one to a shuffle join.

    Beyond the limit adaptive execution splits skewed partitions of the shuffle join.
    """
    return F.broadcast(df) if fits_broadcast(df, rows) else df


def _key_pairs(on: str | Sequence[str] | Mapping[str, str]) -> list[tuple[str, str]]:
    if isinstance(on, str):
        return [(on, on)]
    if isinstance(on, Mapping):
        return list(on.items())
    return [(k, k) for k in on]


def equi_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str] | Mapping[str, str],
    how: str = "left",
    null_safe: bool | Sequence[str] = False,
) -> DataFrame:
    """Join on equal keys; a mapping joins differently named keys. Keeps the left key columns only; another
    column found on both sides comes from the right as ``<name>_y``.

    ``null_safe`` (all keys, or a list of left key names) lets a missing key match a missing key.
    """
    pairs = _key_pairs(on)
    safe = [p[0] for p in pairs] if null_safe is True else list(null_safe or [])
    keys = {r for _, r in pairs}
    both = [c for c in right.columns if c in left.columns and c not in keys]
    renamed = right.withColumnsRenamed({r: f"_r_{r}" for r in keys} | {c: f"{c}_y" for c in both})
    condition = None
    for l, r in pairs:
        other = F.col(f"_r_{r}")
        term = F.col(l).eqNullSafe(other) if l in safe else F.col(l) == other
        condition = term if condition is None else condition & term
    return left.join(renamed, condition, how).drop(*[f"_r_{r}" for r in keys])


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str] | Mapping[str, str],
    how: str = "left",
    null_safe: bool | Sequence[str] = False,
    rows: int = BROADCAST_ROWS,
    derived: bool = False,
) -> DataFrame:
    """Equi-join with a side expected to be small; broadcast only after measuring it.

    Say ``derived`` when the small side is computed from large tables: it is then stored first, so that
    measuring and joining do not compute it twice.
    """
    return equi_join(left, small_side(cut(right) if derived else right, rows), on, how, null_safe)


def keep_matching(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key occurs in the other table."""
    return left.join(right, on, "left_semi")


def flag_matching(
    left: DataFrame, right: DataFrame, on: str | Sequence[str], name: str, rows: int = BROADCAST_ROWS
) -> DataFrame:
    """All rows, with a flag telling whether the key occurs in the other table."""
    keys = [k for k, _ in _key_pairs(on)]
    present = right.select(*keys).distinct().withColumn("_present", F.lit(True))
    joined = lookup_join(left, present, keys, "left", rows=rows, derived=True)
    return joined.withColumn(name, F.col("_present").isNotNull()).drop("_present")


def expand_grid(df: DataFrame, **values: Sequence | Column) -> DataFrame:
    """Every row combined with every entry of each given list or array column."""
    for name, entries in values.items():
        array = entries if isinstance(entries, Column) else F.array(*[F.lit(v) for v in entries])
        df = df.withColumn(name, F.explode(array))
    return df


def even_steps(low: Column, high: Column, length: int) -> Column:
    """Array of ``length`` evenly spaced numbers from ``low`` to ``high``."""
    step = (high - low) / F.lit(float(max(length - 1, 1)))
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: low + i * step)


def bind_by_key(left: DataFrame, right: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Put the columns of two tables side by side by a row key that both carry."""
    return equi_join(left, right, key, "inner")


def stack(tables: Mapping[object, DataFrame], id_column: str) -> DataFrame:
    """Union of tables with a column naming the source; columns missing from one are NULL there."""
    parts = [df.withColumn(id_column, F.lit(name)) for name, df in tables.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result.select(id_column, *[c for c in result.columns if c != id_column])


def common_values(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows found in both tables."""
    return left.intersect(right)


def values_only_in(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of the first table that the second lacks."""
    return left.subtract(right)
