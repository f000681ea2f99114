"""Cutting lineage in the folder that the session names for checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, set as the context's own.

    Where none is named, one machine (a local master) gets a temporary one;
    a cluster's executors could not see that, so there it is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = named or tempfile.mkdtemp(prefix="panelwright-")
        sc.setCheckpointDir(named)
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
