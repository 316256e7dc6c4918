"""Shared storage for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder name below the one that spark.checkpoint.dir names; a temporary one in local mode if it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="collatium-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/cut-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The table written and read again: what it says of its partitions holds at every use."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
