"""Cutting the lineage of iterative jobs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

LOCAL = "file:///tmp/checkpoints"


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once into the folder of spark.checkpoint.dir, which driver and executors share; a local one only where that is unset and the master is local."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or LOCAL)
    return df.checkpoint()


def shared_path(spark, suffix: str) -> str:
    """A new path for a file in the folder that driver and executors share."""
    import uuid

    checkpointed(spark.range(0))  # sets the folder where that is unset
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{uuid.uuid4().hex}{suffix}"
