"""Cutting long plans through the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Write rows that several branches read to the folder that the cluster names in spark.checkpoint.dir; local sessions without one get a temporary folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="paperloom-checkpoint-"))
    return df.checkpoint(eager=True)


def apart(df: DataFrame) -> DataFrame:
    """Rows of papers as one side of a join that is never broadcast. Spark's estimate of them is the size of the packed file that the lines are made from, some hundred times too small, so a whole corpus would be collected by the driver."""
    return df.hint("merge")
