"""Intermediate tables that outlive their executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that one task sorts or groups.
TASK_ROWS = 250_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of its own is made only where that is unset, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp("-checkpoints"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same for wide rows: as compressed Parquet in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *by: str, rows: int) -> DataFrame:
    """Rows dealt by key over so many tasks that each sorts about TASK_ROWS, however many `rows` there are."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // TASK_ROWS)), *by)
