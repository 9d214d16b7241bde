"""Cutting lineage so that a lost executor costs a reread, not a recomputation."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; a temporary one only where none is named and all tasks run in this process.

    On a cluster without a named folder this raises, as its executors share no local one.
    """
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if named is None and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="clausewise-"))


def durable(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder and read back from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
