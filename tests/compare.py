"""Run a query in Spark and its SQL check in DuckDB and compare the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        if (Path(folder) / f"{table}.parquet").exists():
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return db


def _plain(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.5f}") + 0.0
    if hasattr(value, "isoformat"):
        return value.isoformat()[:10]
    if hasattr(value, "item"):
        return _plain(value.item())
    return value


def _key(row):
    return tuple((v is None, str(type(v).__name__), v if v is not None else 0) for v in row)


def rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted((tuple(_plain(v) for v in row) for row in frame[columns].itertuples(index=False)), key=_key)


def _close(a, b) -> bool:
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1.1e-5)
    return a == b


def differences(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} against {sorted(right.columns)}"
    a, b = rows(left), rows(right)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if not all(map(_close, x, y))]
    return f"{len(wrong)} of {len(a)} rows differ, first {wrong[0]}" if wrong else None
