"""Queries of the loop and model family; iterative or fitted, so mostly without SQL."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.labels import clean_labels
from ..operators import ml
from ..operators.agreement import cohen_kappa, macro_f1
from ..operators.loop import Settings, run_loop, variations
from ..operators.splits import half_split
from ..sources.caches import through_cache
from ..sources.connectors import hashed_embedding, map_batches
from ..storage import shared_dir
from . import data
from .catalog import query

CELLS = ["sample_size", "dominant_data_type"]


def _fresh(spark) -> str:
    return f"{shared_dir(spark)}/skewloom/loop-{uuid.uuid4().hex}"


def _loop(spark, sf_dir, **how):
    vocabulary = data.vocabulary(spark, sf_dir)
    label = lambda d: clean_labels(d, vocabulary, CELLS)
    embed = lambda d: map_batches(d, "vector array<float>", hashed_embedding())
    own = data.private(spark, sf_dir, "text", *CELLS)
    klass = (F.col("row_id") % 3).alias("class")
    voters = embed(own.where("text is not null").select(F.col("row_id").alias("id"), klass, "text")).select("id", "class", "vector")
    start = data.pool(spark, sf_dir, "text", *CELLS).select(F.col("row_id").alias("cand_id"), klass, "text", *CELLS)
    target = label(own).withColumn("class", klass)
    s = Settings(k=max(1, start.count() // 7), variations=6, last=1, sigma=2.5788, blind=CELLS, attributes=CELLS, **how)
    if s.by:  # K and its share of the classes
        rows = start.groupBy(s.by).count().collect()  # a row per class
        s = replace(s, class_k={r[0]: max(1, r[1] // 7) for r in rows})
    change = lambda d: d.withColumn("text", F.concat("text", F.lit(" variation "), F.col("copy").cast("string")))
    vary = lambda d, t: variations(d, s.variations, t, change, 1 << 53)
    return run_loop(start, voters, target, s, _fresh(spark), embed, label, vary)


@query()
def pe_two_rounds(spark, sf_dir):
    """Two rounds with metadata: class-free vote, noise, raked selection, variations; the log of the rounds."""
    return _loop(spark, sf_dir, strength=0.5, mode="raked")


@query()
def augpe_two_rounds(spark, sf_dir):
    """A prior sample and two rounds of plain top-K selection."""
    return _loop(spark, sf_dir, mode="plain", prior=100)


@query()
def pe_two_rounds_by_class(spark, sf_dir):
    """Two rounds of vote and raked selection inside each of three classes, each with its own K and marginals."""
    return _loop(spark, sf_dir, strength=0.5, mode="raked", by="class")


@query()
def linear_probe(spark, sf_dir):
    """Kappa of a linear probe on half the vectors for the other half."""
    v = half_split(data.vectors(spark, sf_dir), "id").withColumn("label", F.col("label").cast("string"))
    pairs = ml.probe(v.where("split = 'ref'"), v.where("split = 'query'"))
    return cohen_kappa(pairs.withColumn("attr", F.lit("label")), ["attr"])


@query()
def tfidf_lr(spark, sf_dir):
    """TF-IDF logistic regression of the data type, with C by validation; accuracy and macro-F1 on the test half."""
    d = clean_labels(data.private(spark, sf_dir, "text", "dominant_data_type"), data.vocabulary(spark, sf_dir), ["dominant_data_type"])
    d = half_split(d.where("text is not null").withColumnRenamed("dominant_data_type", "label"), "row_id")
    known, test = d.where("split = 'ref'").drop("split"), d.where("split = 'query'")
    parts = half_split(known, "row_id", seed=1)
    pairs, c = ml.tfidf_classifier(parts.where("split = 'ref'"), parts.where("split = 'query'"), test)
    return macro_f1(pairs.withColumn("attr", F.lit("dominant_data_type")), ["attr"]).withColumn("c", F.lit(c))


@query()
def mlp_vectors(spark, sf_dir):
    """A perceptron of two hidden layers on half the vectors for the other half."""
    v = half_split(data.vectors(spark, sf_dir), "id").withColumn("label", F.col("label").cast("string"))
    return macro_f1(ml.perceptron(v.where("split = 'ref'"), v.where("split = 'query'")).withColumn("attr", F.lit("label")), ["attr"])


@query()
def divergence_frontier(spark, sf_dir):
    """Frontier score of voters and candidates."""
    score = ml.divergence_score(*data.voters_and_candidates(spark, sf_dir))
    return spark.createDataFrame([(score,)], "score double")


@query()
def embedding_cache(spark, sf_dir):
    """Embeddings of all pool texts through a content-keyed cache; each distinct text is computed once."""
    rows = data.pool(spark, sf_dir, "text").where("text is not null").select("row_id", "text")
    cached = through_cache(rows, _fresh(spark), lambda d: map_batches(d, "vector array<float>", hashed_embedding()), "hashed-64")
    return cached.select("row_id", F.size("vector").alias("dimensions"))
