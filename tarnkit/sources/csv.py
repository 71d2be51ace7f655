"""CSV in and out with ``NA`` for missing values."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tarnkit.functions.semantics import nan_to_null

MISSING = "NA"


def read_csv(
    spark: SparkSession, path: str | Sequence[str], schema: StructType | str | None = None, name_filter: str | None = None
) -> DataFrame:
    """Read CSV files with a header. Give a schema for large inputs; otherwise types are inferred.

    Columns are matched by header position, ``NA`` and NaN become NULL.
    """
    reader = spark.read.option("header", True).option("nullValue", MISSING)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return nan_to_null(reader.csv(path))


def read_many(
    spark: SparkSession,
    folder: str,
    name_filter: str,
    schema: StructType | str | None = None,
    source_column: str | None = None,
) -> DataFrame:
    """All files of a folder whose name matches a glob, as one table.

    One scan reads the files that share a header; scans of different headers are united by column name, and columns that a
    file lacks are NULL. A schema is then applied by name, too. ``source_column`` keeps the file name of each row.
    """
    layouts = file_headers(spark, folder, name_filter)
    if len(layouts) < 2:
        return _with_source(read_csv(spark, folder, schema, name_filter), source_column)
    result = None
    for header, paths in layouts:
        names = next(csv.reader([header]))
        table = _with_source(read_csv(spark, paths, _by_name(schema, names)), source_column)
        result = table if result is None else result.unionByName(table, allowMissingColumns=True)
    if schema is None:
        return result
    wanted = [f.name for f in _struct(schema).fields if f.name in result.columns]
    return result.select(*wanted, *([source_column] if source_column else []))


def file_headers(spark: SparkSession, folder: str, name_filter: str) -> list[tuple[str, list[str]]]:
    """Each different first line and the files that begin with it, ordered by the first file's path."""
    lines = spark.read.option("pathGlobFilter", name_filter).text(folder).where("_metadata.file_block_start = 0")
    firsts = lines.select("value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at")).groupBy(
        "path").agg(F.min_by("value", "at").alias("header"))
    found = firsts.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()
    return sorted(((r["header"], r["paths"]) for r in found), key=lambda x: x[1])


def _with_source(df: DataFrame, source_column: str | None) -> DataFrame:
    return df.withColumn(source_column, F.col("_metadata.file_name")) if source_column else df


def _struct(schema: StructType | str) -> StructType:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _by_name(schema: StructType | str | None, names: Sequence[str]) -> StructType | None:
    if schema is None:
        return None
    known = {f.name: f for f in _struct(schema).fields}
    return StructType([known.get(n, StructField(n, StringType())) for n in names])


def read_layouts(
    spark: SparkSession, paths: Sequence[str], schemas: Sequence[StructType | str | None] | None = None
) -> DataFrame:
    """Union by column name of files whose columns differ; absent columns are NULL."""
    tables = [read_csv(spark, p, s) for p, s in zip(paths, schemas or [None] * len(paths))]
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table, allowMissingColumns=True)
    return result


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a folder of CSV files with headers, missing values as ``NA``."""
    df.write.mode(mode).option("header", True).option("nullValue", MISSING).csv(path)
