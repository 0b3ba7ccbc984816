"""Text tables from CSV or Parquet."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..spec import Dataset

#: Cells that a CSV reader of data frames takes for missing.
MISSING = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "n/a", "#N/A", "<NA>")


def read_csv(spark: SparkSession, path: str, schema: StructType | str, rename: Mapping[str, str] | None = None) -> DataFrame:
    """A CSV with header and quoted multi-line text, under an explicit schema; cells of ``MISSING`` become null in string columns."""
    df = spark.read.csv(path, header=True, schema=schema, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")
    df = df.withColumnsRenamed(dict(rename or {"word count": "word_count"}))
    return df.withColumns({c: F.when(~F.col(c).isin(*MISSING), F.col(c)) for c, kind in df.dtypes if kind == "string" and c != "text"})


def with_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows with a text that is not null."""
    return df.where(F.col(text).isNotNull())


def load(spark: SparkSession, root: str, name: str, text_required: bool = True, **files: str) -> DataFrame:
    """A table of a data folder, whose file name may hold settings such as an epsilon: ``load(s, d, 'aim_eps{eps}', eps='4.0')``."""
    df = spark.read.parquet(f"{root}/{name.format(**files)}.parquet")
    return with_text(df) if text_required else df


def dataset_path(dataset: Dataset, root: str, role: str, epsilon: float | None = None) -> str:
    """Where a dataset keeps the table of a role ('private', 'test', 'validation', 'aim', 'pool'); ``{eps}`` is the budget to one decimal."""
    if role not in dataset.files:
        raise KeyError(f"no file for {role}; there are {sorted(dataset.files)}")
    return f"{root.rstrip('/')}/{dataset.files[role].format(eps='' if epsilon is None else f'{epsilon:.1f}')}"


def load_role(spark: SparkSession, dataset: Dataset, root: str, role: str, epsilon: float | None = None, schema: StructType | str | None = None) -> DataFrame:
    """The table of a role, from Parquet, or from CSV under ``schema``. Private and test rows need a text, others do not.

    The metadata of an infinite budget ('aim') are the private records' own columns.
    """
    if role == "aim" and epsilon is not None and math.isinf(epsilon):
        own = load_role(spark, dataset, root, "private", schema=schema)
        return own.select(*(c for c in (*dataset.attributes, dataset.class_id) if c in own.columns))
    path = dataset_path(dataset, root, role, epsilon)
    df = read_csv(spark, path, schema) if path.endswith(".csv") else spark.read.parquet(path)
    return with_text(df, dataset.text) if role in ("private", "test") else df


def check_root(spark: SparkSession, root: str, dataset: str, default: str) -> None:
    """Refuses a folder that belongs to another dataset: its one-line file DATASET names its own, no file means the default."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/DATASET")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    own = spark.read.text(f"{root}/DATASET").first()[0].strip() if there else default
    if own != dataset:
        raise ValueError(f"{root} belongs to {own}, not {dataset}")


def class_map(df: DataFrame, pair: Sequence[str], class_id: str) -> DataFrame:
    """(pair, class_id), one row per pair; fails if a pair has several ids."""
    one = df.groupBy(*pair).agg(F.count_distinct(class_id).alias("_n"), F.min(class_id).alias(class_id))
    wrong = F.raise_error(F.concat(F.lit("several class ids for "), F.concat_ws("/", *pair)))
    return one.withColumn(class_id, F.when(F.col("_n") <= 1, F.col(class_id)).otherwise(wrong.cast(dict(df.dtypes)[class_id]))).drop("_n")


def class_conflicts(df: DataFrame, pair: Sequence[str], class_id: str) -> DataFrame:
    """(pair, ids): pairs that occur with several class ids, so that no class map exists; null ids do not count."""
    return df.groupBy(*pair).agg(F.count_distinct(class_id).alias("ids")).where("ids > 1")


def add_class_id(df: DataFrame, mapping: DataFrame, pair: Sequence[str], class_id: str) -> DataFrame:
    """Adds the class id of the pair; rows of an unknown pair drop out; a table that has ids stays as it is."""
    return df if class_id in df.columns else df.join(mapping, list(pair))


def first_rows(df: DataFrame, n: int, key: str) -> DataFrame:
    """The n rows of the smallest key: a limit that is asked for."""
    return df.orderBy(key).limit(n)


def with_variations(survivors: DataFrame, times: int) -> DataFrame:
    """The survivors, with ``copy`` -1, and after them ``times`` copies of each."""
    return survivors.withColumn("copy", F.lit(-1)).unionByName(replicated(survivors, times))


def replicated(df: DataFrame, times: int) -> DataFrame:
    """Every row ``times`` times, with ``copy`` from 0."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times > 0 else df.withColumn("copy", F.lit(0)).limit(0)


def shards(df: DataFrame, index: str, count: int) -> DataFrame:
    """Adds ``shard`` and ``merged``, the row's place after the shards are concatenated in order."""
    n = F.col(index)
    size = lambda s, total: F.floor((total - s - 1) / count) + 1
    total = df.agg(F.count(F.lit(1)).alias("_t"))
    d = df.withColumn("shard", F.pmod(n, F.lit(count))).join(F.broadcast(total))  # one row
    before = F.aggregate(F.sequence(F.lit(0), F.lit(count - 1)), F.lit(0).cast("bigint"), lambda s, k: s + F.when(k < F.col("shard"), size(k, F.col("_t"))).otherwise(0))
    return d.withColumn("merged", before + F.floor(n / count)).drop("_t")
