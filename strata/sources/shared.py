"""The folder that driver and executors share, and tables that are written there to cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a session on one machine gets a folder of its own, and a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="strata-")
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint: computed once, and kept where a lost executor takes nothing along; its columns are new ones, so it joins with what it came from."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint().select(*(F.col(f"`{c}`").alias(c) for c in df.columns))
