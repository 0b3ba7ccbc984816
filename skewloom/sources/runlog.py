"""Run logs: one JSON line per finished round, with the settings in the path."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SWEEP_PATH = r"([^/]+)/lam([0-9.]+)(?:_seed([0-9]+))?/[^/]+$"
#: The same one level deeper, under a folder of a privacy budget.
BUDGET_PATH = r"(?:^|/)eps([^/]+)/" + SWEEP_PATH
#: Runs of the plain method, and the runs of the sweep at strength 0; other strengths such as lam0.5 are no such runs.
SEED_PATH = r"(?:^|/)seed([0-9]+)/[^/]+$"
BASE_PATH = r"(?:^|/)lam0(?:\.0)?(?:_seed([0-9]+))?/[^/]+$"
#: Folders of runs, by either method.
RUN_FOLDER = r"^(lam[0-9.]+(_seed[0-9]+)?|seed[0-9]+)$"


def path_fields(df: DataFrame, path: str) -> DataFrame:
    """Adds ``annotator``, ``lam`` and ``seed`` (0 if absent) of a sweep path; rows of other paths drop out."""
    part = lambda k: F.regexp_extract(path, SWEEP_PATH, k)
    d = df.where(F.col(path).rlike(SWEEP_PATH))
    return d.withColumns({
        "annotator": part(1), "lam": F.rtrim(part(2), F.lit(".")).cast("double"),
        "seed": F.when(part(3) != "", part(3)).otherwise("0").cast("int"),
    })


def budget_fields(df: DataFrame, path: str) -> DataFrame:
    """As ``path_fields``, with ``eps`` from the folder above the annotator's; rows of other paths drop out."""
    found = path_fields(df.where(F.col(path).rlike(BUDGET_PATH)), path)
    return found.withColumn("eps", F.regexp_extract(path, BUDGET_PATH, 1))


def two_methods(plain: DataFrame, sweep: DataFrame, prior: DataFrame | None = None, path: str = "log_path", names: tuple[str, str] = ("plain", "sweep")) -> DataFrame:
    """Logs of the plain method and of the sweep's runs at strength 0, with ``method`` and ``seed`` (0 if absent); metrics of the prior
    sample are the plain method's round -1. Paths of other runs drop out."""
    seed = lambda pattern: F.coalesce(F.try_element_at(F.regexp_extract_all(path, F.lit(pattern), 1), F.lit(1)), F.lit(""))
    number = lambda pattern: F.when(seed(pattern) != "", seed(pattern)).otherwise("0").cast("int")
    of = lambda d, pattern, name: d.where(F.col(path).rlike(pattern)).withColumns({"method": F.lit(name), "seed": number(pattern)})
    every = of(plain, SEED_PATH, names[0])
    if prior is not None:
        every = prior_as_round(of(prior, SEED_PATH, names[0]), every)
    return every.unionByName(of(sweep, BASE_PATH, names[1]), allowMissingColumns=True)


def run_folders(paths: DataFrame, path: str = "log_path") -> DataFrame:
    """(folder): distinct folders of the files that are named as runs are."""
    folder = F.regexp_replace(path, r"/[^/]*$", "")
    named = F.element_at(F.split(folder, "/"), -1).rlike(RUN_FOLDER)
    return paths.select(folder.alias("folder")).where(named).distinct()


def find_run_folders(spark: SparkSession, root: str, pattern: str = "*/lam*", files: str = "round*") -> list[str]:
    """Run folders under ``root`` that hold round files, in order; none is an error, as a job that finds nothing must not look done."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{pattern}/{files}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    folders = {re.sub(r"^file:/+", "file:///", f.getPath().getParent().toString()) for f in found or []}
    runs = sorted(f for f in folders if re.match(RUN_FOLDER, f.rsplit("/", 1)[-1]))
    if not runs:
        raise FileNotFoundError(f"no run folder with {files} matches {root}/{pattern}")
    return runs


def no_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null, so that aggregates skip it."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")})


def read_logs(spark: SparkSession, pattern: str, schema: StructType | str | None = None) -> DataFrame:
    """The lines of all files of a glob with ``log_path`` and ``line_no``, in file order, and ``done`` if the folder has a file DONE.

    Each file is one value, split by Spark, as only that keeps the order of its lines; a log has a
    line per round.
    """
    files = spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("log_path"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    files = files.where(F.trim("line") != "")
    if schema is None:
        schema = spark.read.json(pattern).schema
    parsed = files.withColumn("_j", F.from_json("line", schema)).select("log_path", "line_no", "_j.*")
    folder = lambda c: F.regexp_replace(c, r"/[^/]*$", "")
    parsed = parsed.withColumn("_f", folder(F.col("log_path")))
    done = _done_folders(spark, pattern)
    return parsed.join(F.broadcast(done), "_f", "left").withColumn("done", F.coalesce("done", F.lit(False))).drop("_f")


def _done_folders(spark: SparkSession, pattern: str) -> DataFrame:
    """Folders of the glob that hold a file DONE; one row per run."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern.rsplit("/", 1)[0] + "/DONE")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    names = [(re.sub(r"^file:/+", "file:///", f.getPath().getParent().toString()), True) for f in found or []]
    return spark.createDataFrame(names, "_f string, done boolean")


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; re-logged rounds replace earlier ones. Combined before the shuffle."""
    row = F.max(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.struct(*(c for c in df.columns if c not in keys)).alias("r"))).alias("m")
    return df.groupBy(*keys).agg(row).select(*keys, "m.r.*")


def join_side_file(logs: DataFrame, side: DataFrame, keys: list[str], prefix: str = "mauve_", order: str = "line_no") -> DataFrame:
    """Adds the columns of a side file that begin with ``prefix``; its last line per round counts."""
    extra = [c for c in side.columns if c.startswith(prefix)]
    return logs.join(keep_last(side.select(*keys, order, *extra), keys, [F.col(order)]).drop(order), keys, "left")


def last_round(df: DataFrame, run: list[str], round_: str = "round") -> DataFrame:
    """The last round of each run."""
    w = Window.partitionBy(*run).orderBy(F.col(round_).desc())
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def prior_as_round(prior: DataFrame, rounds: DataFrame) -> DataFrame:
    """Metrics of the prior sample as round -1 before the others."""
    return prior.withColumn("round", F.lit(-1)).unionByName(rounds, allowMissingColumns=True)
