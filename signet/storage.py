"""The folder that driver and executors share, and tables that are kept in it between the steps of one query."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only in local mode, where it is unset, a fresh folder."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="signet-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """What several later steps use, computed once; it survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
