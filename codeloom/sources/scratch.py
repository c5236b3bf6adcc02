"""The folder that driver and executors share, and cuts of a plan's lineage in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only in local mode, where executors share it with the driver."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="codeloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, by a checkpoint in the shared folder."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)
