"""The test tables as the operators' inputs, in DataFrames and as common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashrng import uniform, uniform_sql
from ..functions.labels import SPACE, clean_labels, to_long
from ..sources.runlog import keep_last, no_nan, path_fields
from ..spec import Vocabulary

ATTRIBUTES = [
    "primary_research_area", "model_organism", "experimental_approach", "dominant_data_type",
    "research_focus_scale", "disease_mention", "sample_size", "research_goal",
]
#: Fixed value: how baselines are named in the run log.
BASELINE = "maple"
#: Columns of the run log that are distances or scores.
METRICS = ["mauve", "jsd_mean", "jsd_blind_mean", "jsd_other_mean", "jsd_word_count"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ctes(*parts: str) -> str:
    """WITH and the parts, each 'name AS (...)'."""
    return "WITH " + ",\n".join(parts) + "\n"


# private records: the last delivery of each

PRIVATE_SQL = "private AS (SELECT * FROM biorxiv_train_metadata QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY loaded_at DESC) = 1)"
POOL_SQL = "pool1 AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY generated_at DESC) = 1)"


def private(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    columns = columns or (*ATTRIBUTES, "word_count", "text")
    d = table(spark, sf_dir, "biorxiv_train_metadata").select("row_id", "loaded_at", *columns)
    return keep_last(d, ["row_id"], [F.col("loaded_at")])


def pool(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    d = table(spark, sf_dir, "pool").select("row_id", "generated_at", *columns)
    return keep_last(d, ["row_id"], [F.col("generated_at")])


def vocabulary(spark: SparkSession, sf_dir: str) -> Vocabulary:
    return Vocabulary.from_table(table(spark, sf_dir, "schema_options"))


# clean labels, long

VOCAB_SQL = "vocab AS (SELECT attr, list(option_value ORDER BY ord) AS opts, max(option_value) FILTER (is_fallback) AS fb FROM schema_options GROUP BY attr)"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def long_sql(name: str, source: str, ids: str, columns: dict[str, str]) -> str:
    """``name`` AS one row per record and attribute of ``source``; columns: attr -> expression."""
    parts = " UNION ALL ".join(f"SELECT {ids}, '{a}' AS attr, {c} AS value FROM {source}" for a, c in columns.items())
    return f"{name} AS ({parts})"


def cleaned_sql(name: str, source: str, ids: str) -> str:
    """``name`` AS the clean labels of a long table ``source``."""
    v = strip_sql("value")
    return f"""{name} AS (SELECT {ids}, attr, CASE WHEN v IS NULL THEN fb WHEN list_contains(opts, v) THEN v
        ELSE coalesce(list_filter(opts, lambda o: starts_with(o, v) OR starts_with(v, o))[1], fb) END AS value
        FROM (SELECT {ids}, attr, {v} AS v FROM {source}) JOIN vocab USING (attr))"""


PRIVATE_LONG_SQL = [PRIVATE_SQL, VOCAB_SQL, long_sql("praw", "private", "row_id", {a: a for a in ATTRIBUTES}), cleaned_sql("plong", "praw", "row_id")]
POOL_LONG_SQL = [POOL_SQL, long_sql("qraw", "pool1", "row_id", {a: a for a in ATTRIBUTES}), cleaned_sql("qlong", "qraw", "row_id")]


def private_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_long(clean_labels(private(spark, sf_dir, *ATTRIBUTES), vocabulary(spark, sf_dir), ATTRIBUTES), ["row_id"], ATTRIBUTES)


def pool_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_long(clean_labels(pool(spark, sf_dir, *ATTRIBUTES), vocabulary(spark, sf_dir), ATTRIBUTES), ["row_id"], ATTRIBUTES)


# vectors: one half votes, the other half are candidates


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "embeddings")
    return d.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label", (F.col("label") % 3).alias("class"), is_voter(F.col("vec_id")).alias("voter"))


def is_voter(key: Column) -> Column:
    return uniform(0, "set", key) < 0.5


VECTORS_SQL = f"""vectors AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vector, label, label % 3 AS class, {uniform_sql(0, 'set', 'vec_id')} < 0.5 AS voter FROM embeddings),
voters AS (SELECT * FROM vectors WHERE voter), cands AS (SELECT * FROM vectors WHERE NOT voter)"""


def voters_and_candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = vectors(spark, sf_dir)
    return v.where("voter"), v.where("not voter")


DISTANCE = "list_sum(list_transform(list_zip(v.vector, c.vector), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def nearest_sql(name: str, k: int, queries: str = "voters", refs: str = "cands", by: str | None = None) -> str:
    """``name`` AS (query_id, ref_id, distance, rank) in SQL."""
    same = f"WHERE v.{by} = c.{by}" if by else ""
    return f"""{name} AS (SELECT query_id, ref_id, distance, rank FROM (SELECT v.id AS query_id, c.id AS ref_id, round({DISTANCE}, 9) AS distance,
        row_number() OVER (PARTITION BY v.id ORDER BY round({DISTANCE}, 9), c.id) AS rank FROM {queries} v, {refs} c {same}) WHERE rank <= {k})"""


# run log


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed paths, NaN as null, the last line of every round."""
    d = no_nan(path_fields(table(spark, sf_dir, "run_log"), "log_path"))
    return keep_last(d, ["annotator", "lam", "seed", "round"], [F.col("logged_at")])


_RE = "([^/]+)/lam([0-9.]+)(?:_seed([0-9]+))?/[^/]+$"
RUNLOG_SQL = f"""logs AS (SELECT regexp_extract(log_path, '{_RE}', 1) AS annotator, rtrim(regexp_extract(log_path, '{_RE}', 2), '.')::DOUBLE AS lam,
    (CASE WHEN regexp_extract(log_path, '{_RE}', 3) = '' THEN '0' ELSE regexp_extract(log_path, '{_RE}', 3) END)::INTEGER AS seed, round, moved, shortfall, logged_at, log_path,
    {', '.join(f'CASE WHEN isnan({m}) THEN NULL ELSE {m} END AS {m}' for m in METRICS)}
    FROM run_log WHERE regexp_matches(log_path, '{_RE}')
    QUALIFY row_number() OVER (PARTITION BY annotator, lam, seed, round ORDER BY logged_at DESC NULLS LAST, log_path DESC, {', '.join(f'{m} DESC NULLS LAST' for m in METRICS)}, moved DESC NULLS LAST, shortfall DESC NULLS LAST) = 1)"""


def t_table_sql() -> str:
    """The quantiles of Student's t as a table."""
    from ..functions.distributions import t_table

    return "tq AS (SELECT * FROM (VALUES " + ", ".join(f"({df}, {t:.12f}::DOUBLE)" for df, t in t_table()) + ") AS v(df, t))"


def interval_sql(sd: str, n: str) -> str:
    return f"(SELECT t FROM tq WHERE tq.df = least({n} - 1, 200)) * {sd} / sqrt({n})"
