"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROWS_A_FILE = 100_000
"""Of a narrow table."""
BROADCAST_ROWS = 200_000
"""A side is broadcast only if it is counted and has at most so many (small, fixed-width) rows."""


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, not once for each place that names it."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character as it is (``lower`` is the fast path where both agree)."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    Where ``spark.checkpoint.dir`` is unset, a session on one machine gets a local folder of its own; on a cluster that is an error, as executors would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpuslab-")
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, path: str) -> None:
    """Without the marker of success, which the driver would write: nothing else reads these files, and for each file it makes the driver may fork with all its memory."""
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: lineage ends here, and a lost executor loses nothing."""
    path = shared_dir(df.sparkSession, name)
    written(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hold_for(result: DataFrame, held: DataFrame) -> DataFrame:
    """``result``, for which ``held`` stays on the executors' disks until nothing in Python refers to it; what reads it later computes ``held`` again."""
    weakref.finalize(result, held.unpersist).atexit = False
    return result


class Scratch:
    """Intermediates that nothing reads any more once the operator has written its result.

    ``hold`` keeps rows on the executors' disks and their lineage with them: a lost executor's share is computed again from the last shuffle or written table.
    ``materialise`` writes a table, which cuts the lineage.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.held = spark, [], []

    def hold(self, df: DataFrame) -> DataFrame:
        self.held.append(df.persist(StorageLevel.DISK_ONLY))
        return self.held[-1]

    def materialise(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(shared_dir(self.spark, name))
        written(df, self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def free(self) -> None:
        """Tables go through Hadoop's file system."""
        for df in self.held:
            df.unpersist()
        for path in self.paths:
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        self.held, self.paths = [], []


class settings:
    """Settings of the session; as a context, it has its old ones back afterwards."""

    def __init__(self, spark: SparkSession, values: dict[str, object]):
        self.spark, self.old = spark, {k: spark.conf.get(k) for k in values}
        for k, v in values.items():
            spark.conf.set(k, v)

    def __enter__(self) -> None:
        pass

    def __exit__(self, *error) -> None:
        for k, v in self.old.items():
            self.spark.conf.set(k, v)


def bounded_batches(spark: SparkSession, rows: int = 512, size: int = 4 << 20) -> settings:
    """Lowers the session's rows and bytes an Arrow batch: texts and sets are long, and a batch is held in the executor and in the worker.

    A row larger than ``size`` is a batch alone. Only an operator that has computed its result when it returns can use it as a context: Spark reads the values
    when a result is computed, so for others the lower values stay.
    """
    most = {f"spark.sql.execution.arrow.{k}": v for k, v in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size))}
    return settings(spark, {k: v for k, v in most.items() if not ((now := spark.conf.get(k)).isdigit() and 0 < int(now) <= v)})


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows, found without reading more than that of them."""
    return df.limit(rows + 1).count() <= rows
