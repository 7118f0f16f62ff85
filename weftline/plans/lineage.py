"""Cutting lineage in the folder that the cluster names for it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the folder of ``spark.checkpoint.dir``."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one in a session of one process that names none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return found or tempfile.mkdtemp(prefix="checkpoints-")
