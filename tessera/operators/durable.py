"""Cuts of lineage that survive a lost executor: checkpoints in the folder that all executors share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where it is unset and all of Spark runs in this process."""
    context = spark.sparkContext
    held = context.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or held
    if folder is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
    if held is None:
        context.setCheckpointDir(folder)
    return folder


def run_once(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint, so that what made them isn't run again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Whether Spark deletes a query's shuffle files at its end instead of when the driver next collects garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned_shuffles(spark: SparkSession) -> Iterator[None]:
    """What a write inside has shuffled is deleted when the write is done."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


def stored_once(df: DataFrame) -> DataFrame:
    """The rows as Parquet in the shared folder: like run_once(), where they are many or are read a few columns at a time."""
    spark, folder = df.sparkSession, f"{shared_folder(df.sparkSession)}/rows-{uuid4().hex}"
    with cleaned_shuffles(spark):
        df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
