"""Queries over the test tables, one function per registered name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import canonical, consensus, leakage, packing, quota_sample, splits, termfreq, truncation, vocabulary

ATTRIBUTES = [
    "primary_research_area", "model_organism", "experimental_approach", "dominant_data_type",
    "research_focus_scale", "disease_mention", "sample_size", "research_goal",
]
SPLITS = {"train": 0.70, "validation": 0.15, "test": 0.15}
VOTED = ["primary_research_area", "dominant_data_type", "sample_size"]
QUOTA_ATTRIBUTES = ["sample_size", "dominant_data_type", "word_count"]
TERM_ATTRIBUTES = ["model_organism", "disease_mention", "experimental_approach"]
MAPPED = ["model_organism", "primary_research_area", "sample_size"]
CAPACITY = 4096


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# 1. splits that keep related records together


def _pool_edges(pool: DataFrame) -> DataFrame:
    prompt = splits.group_edges(pool, "row_id", [*ATTRIBUTES, "word_count_requested"])
    return prompt.unionByName(splits.reference_edges(pool, "row_id", "parent_row_id"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pool row of a family of two or more, with the family's smallest row_id."""
    found = splits.components(_pool_edges(_table(spark, sf_dir, "pool")))
    return found.select(F.col("node").alias("row_id"), F.col("component").alias("family_row_id"))


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every pool row."""
    pool = _table(spark, sf_dir, "pool")
    return splits.grouped_split(pool, "row_id", _pool_edges(pool), SPLITS).withColumnRenamed("family", "family_row_id")


# 2. consensus from several annotators' labels


def _votes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The annotators' votes, and the record's own labels as one more annotator."""
    options = _table(spark, sf_dir, "schema_options")
    raw = consensus.latest_votes(
        _table(spark, sf_dir, "train_annotations"), "row_id", "annotator", {f"map_{a}": a for a in VOTED}, ["annotated_at", "loaded_at", "annotation_id"]
    )
    own = termfreq.latest(_table(spark, sf_dir, "biorxiv_train_metadata"), "row_id", VOTED, "loaded_at")
    labels = F.array(*(F.struct(F.lit(a).alias("attr"), F.col(a).alias("value")) for a in VOTED))
    own = own.select(F.col("row_id").alias("item"), F.lit("the record itself").alias("annotator"), F.inline(labels))
    return consensus.match_options(raw, options), consensus.match_options(own, options)


def _consensus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    votes, own = _votes(spark, sf_dir)
    return consensus.consensus(votes, extra=own)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The option that is right for every record and field on which annotators disagree."""
    items, _ = _consensus(spark, sf_dir)
    return items.where("options >= 2").select(F.col("item").alias("row_id"), "attr", F.col("option").alias("option_id"))


def p2_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus and agreement of every record and field with a vote."""
    items, _ = _consensus(spark, sf_dir)
    return items.select(F.col("item").alias("row_id"), "attr", F.col("option").alias("option_id"), F.round("confidence", 6).alias("confidence"), F.round("agreement", 6).alias("agreement"), "annotators", "options")


def p2_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability of every annotator by field."""
    _, reliability = _consensus(spark, sf_dir)
    return reliability


# 3. sample matching target category proportions


def _quota_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = quota_sample.labelled_rows(_table(spark, sf_dir, "pool"), "shard", "row_id", "text", QUOTA_ATTRIBUTES, "word_count")
    return rows, quota_sample.target_table(_table(spark, sf_dir, "quota_targets"), "shard")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that a shard's rows cannot meet."""
    rows, targets = _quota_inputs(spark, sf_dir)
    return quota_sample.shortfalls(rows, targets, QUOTA_ATTRIBUTES).select(F.col("stratum").alias("shard"), "attr", "category")


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample of every shard."""
    rows, targets = _quota_inputs(spark, sf_dir)
    return quota_sample.quota_sample(rows, targets, QUOTA_ATTRIBUTES, incomplete=True).withColumnsRenamed({"stratum": "shard", "id": "row_id"})


def p3_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that the drawn sample of a shard leaves below the greater of share*k and min_rows, with the reason."""
    rows, targets = _quota_inputs(spark, sf_dir)
    sample = quota_sample.quota_sample(rows, targets, QUOTA_ATTRIBUTES, incomplete=True)
    return quota_sample.sample_misses(sample, targets, QUOTA_ATTRIBUTES, rows).withColumnRenamed("stratum", "shard")


# 4. frequency of every distinct value or term


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and records of every term, with its mark."""
    found = termfreq.term_frequency(_table(spark, sf_dir, "biorxiv_train_metadata"), "row_id", TERM_ATTRIBUTES, "loaded_at")
    return found.withColumn("share", F.round("share", 9))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms too rare or too common to be useful."""
    return p4_terms(spark, sf_dir).where("mark is not null").select("attr", "term", "mark")


# 5. mapping free-entered values to a canonical list


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference entry meant by every typed term that is none; -1 if there is none."""
    how = canonical.Matching(aliases=vocabulary.ALIASES, bins=vocabulary.SIZE_BINS, fillers=vocabulary.FILLERS)
    found = canonical.map_values(_table(spark, sf_dir, "biorxiv_train_metadata"), "row_id", MAPPED, _table(spark, sf_dir, "reference_values"), how)
    return found.select("row_id", "attr", "term", "ref_id")


# 6. filling fixed-capacity containers


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The containers with their documents' pieces."""
    sizes = packing.token_sizes(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.pack(sizes, CAPACITY).withColumnRenamed("id", "doc_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that exceed a container by themselves."""
    return packing.oversized(p6_containers(spark, sf_dir).withColumnRenamed("doc_id", "id")).withColumnRenamed("id", "doc_id")


# 7. evaluation texts leaking into training text


def p7_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and proximity matches of every evaluation passage in every document."""
    found = leakage.find_passages(_table(spark, sf_dir, "documents"), "doc_id", "text", _table(spark, sf_dir, "eval_items"), "item_id", "passage")
    return found.withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold ten or more consecutive words of a passage."""
    return p7_matches(spark, sf_dir).where("match = 'exact'").select("doc_id", "item_id").distinct()


# 8. text cut off by field limits


def _truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_scores(_table(spark, sf_dir, "documents"), "doc_id", "text", "source")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text was cut."""
    return _truncation(spark, sf_dir).where("truncated").select(F.col("id").alias("doc_id"))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut texts by source."""
    return truncation.truncation_rates(_truncation(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_splits, p2_found, p2_consensus, p2_annotators, p3_found, p3_sample, p3_misses, p4_found, p4_terms,
        p5_found, p6_found, p6_containers, p7_found, p7_matches, p8_found, p8_rates,
    )
}
