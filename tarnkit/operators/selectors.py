"""Choose, rename and order columns by name pattern or type. Everything here is decided from the schema."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

Selector = Callable[[T.StructType], list[str]]


def contains(*parts: str) -> Selector:
    """Columns whose name contains any of the parts."""
    return lambda schema: [n for n in schema.names if any(p in n for p in parts)]


def matches(pattern: str) -> Selector:
    """Columns whose name matches a regular expression anywhere."""
    return lambda schema: [n for n in schema.names if re.search(pattern, n)]


def all_of(names: Iterable[str]) -> Selector:
    """Exactly these columns; a missing one is an error."""

    def pick(schema: T.StructType) -> list[str]:
        absent = [n for n in names if n not in schema.names]
        if absent:
            raise KeyError(f"columns not found: {absent}")
        return list(names)

    return pick


def any_of(names: Iterable[str]) -> Selector:
    """Those of the columns that exist."""
    return lambda schema: [n for n in names if n in schema.names]


def between(first: str, last: str) -> Selector:
    """Columns from one name to another in table order."""
    return lambda schema: schema.names[schema.names.index(first) : schema.names.index(last) + 1]


def numeric() -> Selector:
    """Columns holding numbers."""
    return lambda schema: [f.name for f in schema.fields if isinstance(f.dataType, T.NumericType)]


def everything() -> Selector:
    return lambda schema: list(schema.names)


def _resolve(schema: T.StructType, selectors) -> list[str]:
    names: list[str] = []
    for selector in selectors:
        picked = selector(schema) if callable(selector) else all_of([selector])(schema)
        names += [n for n in picked if n not in names]
    return names


def column_names(df: DataFrame, *include, exclude: Sequence = ()) -> list[str]:
    """Names picked by ``include`` (default all) without those picked by ``exclude``."""
    dropped = set(_resolve(df.schema, exclude))
    return [n for n in _resolve(df.schema, include or (everything(),)) if n not in dropped]


def select_cols(df: DataFrame, *include, exclude: Sequence = ()) -> DataFrame:
    """Select by names and selectors."""
    return df.select(*[f"`{n}`" for n in column_names(df, *include, exclude=exclude)])


def rename(df: DataFrame, new_to_old: Mapping[str, str]) -> DataFrame:
    """Rename columns, given as new name to old name."""
    all_of(new_to_old.values())(df.schema)
    return df.withColumnsRenamed({old: new for new, old in new_to_old.items()})


def relocate(df: DataFrame, *selectors, after: str | None = None, last: bool = False) -> DataFrame:
    """Move columns to the front, behind another column, or to the end."""
    moved = _resolve(df.schema, selectors)
    rest = [n for n in df.columns if n not in moved]
    at = len(rest) if last else rest.index(after) + 1 if after else 0
    return df.select(*[f"`{n}`" for n in (*rest[:at], *moved, *rest[at:])])


def snake_case(name: str) -> str:
    """Lower snake case with units spelled out and camel case split."""
    name = name.replace("%", "_percent_").replace("#", "_number_").replace("µ", "u").replace("'", "")
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    name = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name)
    name = re.sub(r"[^0-9a-zA-Z]+", "_", name).strip("_").lower()
    return f"x{name}" if not name or name[0].isdigit() else name


def clean_names(df: DataFrame) -> DataFrame:
    """Rename every column to snake case; repeated names get _2, _3, ..."""
    seen: dict[str, int] = {}
    fresh = []
    for name in map(snake_case, df.columns):
        seen[name] = seen.get(name, 0) + 1
        fresh.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*fresh)
