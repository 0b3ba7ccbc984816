"""The run-log summary kept up to date while runs are still writing.

New log files arrive in a folder; every micro-batch merges its lines into a small table of the last
line per round, from which a summary is recomputed. The merge is idempotent, so a batch that is
repeated after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.runlog import keep_last, no_nan, path_fields


def follow_run_logs(
    spark: SparkSession, folder: str, schema: str, state: str, checkpoint: str, order: str,
    summarise: Callable[[DataFrame], None] | None = None, available_now: bool = True,
) -> StreamingQuery:
    """Starts the query. ``state`` holds the last line of each (annotator, lam, seed, round) by ``order``.

    The state has a row per finished round. Each batch writes a new version of it beside the old one
    and then points to it, so a reader never sees half a table; versions before the last two are deleted. ``summarise`` gets
    the new state.
    """
    lines = spark.readStream.schema(schema).json(folder, pathGlobFilter="*.jsonl", recursiveFileLookup=True).withColumn("log_path", F.input_file_name())

    def merge(batch: DataFrame, number: int) -> None:
        keys = ["annotator", "lam", "seed", "round"]
        new = no_nan(path_fields(batch, "log_path"))
        old = read_state(spark, state)
        merged = keep_last(new if old is None else old.unionByName(new), keys, [F.col(order)])
        merged.write.mode("overwrite").parquet(f"{state}/version={number}")
        spark.createDataFrame([(number,)], "version long").coalesce(1).write.mode("append").json(f"{state}-versions")
        _drop_versions(spark, state, number - 1)
        if summarise is not None:
            summarise(spark.read.parquet(f"{state}/version={number}"))

    writer = lines.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def _drop_versions(spark: SparkSession, state: str, before: int) -> None:
    """Deletes versions older than ``before``, which readers may still have open."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.listStatus(path):
        name = f.getPath().getName()
        if name.startswith("version=") and int(name[8:]) < before:
            fs.delete(f.getPath(), True)


def read_state(spark: SparkSession, state: str) -> DataFrame | None:
    """The latest version of the state; None before the first batch."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state}-versions")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    last = spark.read.schema("version long").json(f"{state}-versions").agg(F.max("version")).first()[0]
    return None if last is None else spark.read.parquet(f"{state}/version={last}")


def windowed_counts(events: DataFrame, time: str, late: str = "10 minutes", window: str = "5 minutes", by: str = "event_type") -> DataFrame:
    """Events per window and kind with a bound on late ones; for a stream or a table alike."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")
