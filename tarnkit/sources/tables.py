"""Intermediate tables on shared storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of a folder's Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def save_table(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    mode: str = "errorifexists",
    replace_partitions: bool = False,
    max_rows_per_file: int = 5_000_000,
    files_per_key: int | None = None,
) -> DataFrame:
    """Write Parquet partitioned by key columns and return the table read back.

    Cuts lineage on storage that survives executor loss. Rows are gathered by key so that tasks times keys do not make as
    many files, and adaptive execution gives a key as many writers as its measured bytes fill
    (``spark.sql.adaptive.advisoryPartitionSizeInBytes``), whatever its rows hold. ``files_per_key`` fixes the number of
    writers a key by a hash of the row instead. ``replace_partitions`` replaces just the partitions found in ``df``;
    several jobs may do so at once for different partitions.
    """
    if partition_by and files_per_key is None:
        df = df.hint("rebalance", *partition_by)
    elif partition_by:
        share = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_key))
        df = df.repartition(*partition_by, share)
    writer = df.write.option("maxRecordsPerFile", max_rows_per_file)
    if replace_partitions:
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        writer = writer.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def load_table(spark: SparkSession, path: str, **partition) -> DataFrame:
    """Reload a saved table; keyword filters on partition columns read those folders only."""
    df = spark.read.parquet(path)
    for column, value in partition.items():
        df = df.filter(F.col(column) == F.lit(value))
    return df
