"""Cutting the lineage of loops through the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_shared_dir(spark: SparkSession) -> None:
    """Leaves the folder that the cluster names; only where none is set, as in tests, sets a temporary one."""
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not sc.getConf().get("spark.checkpoint.dir") and sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="wayfold-"))


def cut(df: DataFrame) -> DataFrame:
    """df, computed and kept in the shared folder, so that a lost executor doesn't lose it and plans don't grow."""
    ensure_shared_dir(df.sparkSession)
    return df.checkpoint()
