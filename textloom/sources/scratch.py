"""Places for tables and files that queries write and read again."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path in the cluster's shared folder (``spark.checkpoint.dir``); one of our own where it is unset and the master
    is local. Elsewhere a folder of the driver's would not be seen by the executors, so that is an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir()
    return f"{base}/textloom-{uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table of files in the shared folder: what reads it starts from there."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
