"""Long and wide forms, string splitting, and functions applied per group."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def longer(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str] | None = None, name: str = "name", value: str = "value"
) -> DataFrame:
    """Wide to long; NULL values keep their rows. The columns share one type.

    Written as ``inline``: Spark then recognises two uses of the long table as the same shuffle and reads it
    once, which it does not for ``unpivot``.
    """
    columns = list(columns) if columns is not None else [c for c in df.columns if c not in set(ids)]
    entries = [F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in columns]
    return df.select(*ids, F.inline(F.array(*entries)))


def longer_paired(
    df: DataFrame, ids: Sequence[str], sep: str = "_", name: str = "method", columns: Sequence[str] | None = None
) -> DataFrame:
    """Wide to long with several measures at once: ``grab_value, grab_lod`` becomes method, value, lod."""
    columns = list(columns) if columns is not None else [c for c in df.columns if c not in set(ids)]
    groups: dict[str, dict[str, str]] = {}
    for column in columns:
        prefix, measure = column.split(sep, 1)
        groups.setdefault(prefix, {})[measure] = column
    measures = list(dict.fromkeys(m for found in groups.values() for m in found))
    entries = [
        F.struct(
            F.lit(prefix).alias(name),
            *[(F.col(found[m]) if m in found else F.lit(None).cast("double")).alias(m) for m in measures],
        )
        for prefix, found in groups.items()
    ]
    return df.select(*ids, F.inline(F.array(*entries)))


def wider(
    df: DataFrame,
    ids: Sequence[str],
    names_from: str,
    values: Sequence,
    aggregates: Mapping[str, Column],
    glue: str = "{stat}_{name}",
) -> DataFrame:
    """Long to wide. ``aggregates`` maps a statistic to its aggregate; one statistic called "" keeps plain names.

    The list of values is given, so no extra scan looks for them, and columns come grouped by statistic.
    """
    stats = list(aggregates)
    named = [aggregates[s].alias(s or "value") for s in stats]
    pivoted = df.groupBy(*ids).pivot(names_from, list(values)).agg(*named)
    single = len(stats) == 1
    picked = []
    for stat in stats:
        for value in values:
            found = str(value) if single else f"{value}_{stat or 'value'}"
            target = glue.format(stat=stat, name=value) if stat else str(value)
            picked.append(F.col(f"`{found}`").alias(target))
    return pivoted.select(*ids, *picked)


def split_in_two(df: DataFrame, column: str, into: Sequence[str], sep: str) -> DataFrame:
    """Replace a text column by its two parts around a separator."""
    first, second = (F.split_part(F.col(column), F.lit(sep), F.lit(i)) for i in (1, 2))
    return df.withColumns({into[0]: first, into[1]: second}).drop(column)


def per_group(df: DataFrame, keys: Sequence[str], function: Callable, schema: str) -> DataFrame:
    """Run a pandas function on each group: the fall-back where no aggregate expresses it.

    A group must fit in one task; use it for groups bounded by design, such as finished summaries.
    """
    return df.groupBy(*keys).applyInPandas(function, schema)
