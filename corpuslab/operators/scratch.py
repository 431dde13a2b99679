"""The folder that driver and executors share, and tables written there once and read back."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a session on one machine gets a folder of its own; on a cluster that is an error, as executors would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpuslab-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def folder(spark: SparkSession, name: str) -> str:
    """A new name below the shared folder."""
    return os.path.join(shared(spark), f"{name}-{uuid.uuid4().hex}")


def saved(df: DataFrame) -> DataFrame:
    """Cuts the lineage: a lost executor repeats nothing of what came before."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint()
