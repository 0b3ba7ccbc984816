"""Tables written to the folder that all executors share.

Loops cut their lineage with such tables: they outlive any executor, and a later stage reads
columns instead of recomputing. The folder comes from ``spark.checkpoint.dir``. Only a local
master may go without that setting; it then gets a temporary folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_WRITTEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for written tables and checkpoints."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="skewloom-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return f"file://{_LOCAL[app]}"


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once, written as Parquet to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skewloom/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._skewloom_path = path
    return out


def forget(df: DataFrame | None) -> None:
    """Deletes the table behind a frame from ``written``; nothing may read it afterwards."""
    path = getattr(df, "_skewloom_path", None)
    if path and path in _WRITTEN:
        _delete(path, _WRITTEN.pop(path))


@contextmanager
def temporary_tables() -> Iterator[None]:
    """Deletes at its end the tables written inside: results that read them must be stored or collected before.

    Without it they stay until the process ends, as a lazy result may read them at any time. Long sessions use one block per query.
    """
    before = set(_WRITTEN)
    try:
        yield
    finally:
        for path in set(_WRITTEN) - before:
            _delete(path, _WRITTEN.pop(path))


def _delete(path: str, spark: SparkSession) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_all() -> None:
    for path, spark in list(_WRITTEN.items()):
        try:
            if spark.sparkContext._jsc is not None:
                _delete(path, spark)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            pass
