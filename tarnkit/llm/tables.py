"""Reading the test tables and storing what is read several times."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Tables of up to so many counted rows of a few hundred bytes are broadcast.
BROADCAST_ROWS = 20_000
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the input folder; sets a checkpoint folder where the session has none and runs on one machine."""
    shared_folder(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """From now on the session sends at most `BATCH_ROWS` rows to Python at once: texts are long, and executors' memory is shared."""
    if int(spark.conf.get(BATCH)) > BATCH_ROWS or int(spark.conf.get(BATCH)) <= 0:
        spark.conf.set(BATCH, str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, which driver and executors share."""
    short_batches(spark)
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found


def cut(frame: DataFrame) -> DataFrame:
    """The frame, stored in the checkpoint folder; the shuffle files that made it are then of no more use and go."""
    spark = frame.sparkSession
    shared_folder(spark)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        return frame.select("*").checkpoint()
    finally:
        spark.conf.set(CLEANUP, before)


def extended(frame: DataFrame, columns: list[str], more: str) -> StructType:
    """Schema of the named columns and of those that `more` declares."""
    return StructType([frame.schema[c] for c in columns] + list(StructType.fromDDL(more)))


def small_side(frame: DataFrame, rows: int) -> DataFrame:
    """The frame, marked for broadcast if its counted rows are few enough; else joins shuffle."""
    return F.broadcast(frame) if rows <= BROADCAST_ROWS else frame


def unused(frame: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as no column of the frame has."""
    lead = "__"
    while any(c.lower() in {f"{lead}{n}".lower() for n in names} for c in frame.columns):
        lead += "_"
    return [f"{lead}{n}" for n in names]
