"""Resumable loads: landed files as a stream, keys seen once, appended by batch, with a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, schema, files_a_batch: int = 50) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def _timed(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a timestamp with a zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def new_rows(df: DataFrame, ts: str, *keys: str, delay: str = "1 day") -> DataFrame:
    """The first row of each key, forgotten after the delay."""
    return _timed(df, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark([*keys])


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def append_unseen(df: DataFrame, out: str, checkpoint: str, *keys: str, write=None):
    """Appends rows whose keys were not seen before. Seen keys are state of the stream (on the executors' disks, saved to the checkpoint by batch), looked up by key, so a batch reads
    nothing of ``out``, however much there is.

    A batch is written to a folder of its own number, and one that is run again after a failure writes the same folder again: nothing is added twice, and ``loaded`` reads
    what was finished. Of a batch's rows with one key any one is taken: repeated keys should be repeated rows, or come in later files.
    """
    spark = df.sparkSession
    put = write or (lambda batch, path: batch.write.mode("overwrite").parquet(path))
    name = "spark.sql.streaming.stateStore.providerClass"
    with_default = spark.conf.get(name)
    spark.conf.set(name, ROCKS)  # is read when the query starts
    try:
        return (
            df.dropDuplicates([*keys]).writeStream.foreachBatch(lambda batch, n: put(batch, f"{out}/batch={n}"))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(name, with_default)


def loaded(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).drop("batch")


def daily_counts(df: DataFrame, ts: str, group: str, delay: str = "1 day") -> DataFrame:
    return _timed(df, ts).withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("day"), group).agg(F.count("*").alias("n"))
