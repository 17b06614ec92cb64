"""The folder that driver and executors share, and tables that are written there once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    A session without one gets a temporary folder if it runs in a single process
    (a test); on a cluster that would be one machine's own, so it is an error.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp())
    return context.getCheckpointDir()


def written_once(df: DataFrame) -> DataFrame:
    """df, computed now and read from a table in the shared folder ever after."""
    path = f"{shared_folder(df.sparkSession)}/once-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
