"""Caches of expensive per-text results, keyed by content: only what is missing is computed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_key(text: str = "text"):
    return F.sha1(F.col(text))


def missing(df: DataFrame, cached: DataFrame | None, keys: list[str]) -> DataFrame:
    """Distinct keyed rows of ``df`` that the cache lacks."""
    d = df.dropDuplicates(keys)
    return d if cached is None else d.join(cached.select(*keys), keys, "left_anti")


def through_cache(df: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], model: str, text: str = "text") -> DataFrame:
    """``df`` with the columns that ``compute`` adds to (key, text), computed once per distinct text, model and cache.

    The cache is a Parquet table of (key, model, results); new results are appended before they are
    joined back, so an interrupted run keeps what it finished. Null texts get null results.
    """
    spark = df.sparkSession
    keyed = df.withColumn("_key", text_key(text))
    have = _read(spark, path)
    own = None if have is None else have.where(F.col("model") == model)
    todo = missing(keyed.where(F.col(text).isNotNull()).select("_key", text), own, ["_key"])
    if not todo.isEmpty():
        compute(todo).drop(text).withColumn("model", F.lit(model)).write.mode("append").parquet(path)
    results = spark.read.parquet(path).where(F.col("model") == model).drop("model").dropDuplicates(["_key"])
    return keyed.join(results, "_key", "left").drop("_key")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.parquet(path)


def annotations_to_do(rows: DataFrame, log: DataFrame, key: str, order: str, retry_errors: bool = False) -> DataFrame:
    """Rows without a usable last annotation in an append-only log of (key, labels, error)."""
    last = log.groupBy(key).agg(F.max_by(F.struct("labels", "error"), order).alias("m"))
    done = last.where(F.col("m.error").isNull()) if retry_errors else last
    return rows.join(done.select(key), key, "left_anti")
