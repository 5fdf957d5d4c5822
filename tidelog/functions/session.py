"""The folder that driver and executors share, and reliable checkpoints in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session or its context.

    Where the setting is absent, a master on one machine gets a temporary
    folder; on a cluster that would be a folder that executors cannot see, so
    it is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and sc.getCheckpointDir() is None and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidelog-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The frame with its rows and partitions fixed in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
