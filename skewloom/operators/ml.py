"""Classifiers on vectors and texts, on pyspark.ml."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, SQLTransformer, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .agreement import cohen_kappa, jensen_shannon
from .splits import half_split


def standardised(train: DataFrame, others: list[DataFrame], vector: str = "vector") -> list[DataFrame]:
    """Frames with ``features``: entries minus the training mean over the population deviation plus 1e-6."""
    entry = train.select(F.posexplode(vector).alias("i", "x"))
    stats = entry.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    wide = stats.agg(F.sort_array(F.collect_list(F.struct("i", "m", "s"))).alias("_z"))
    scale = lambda d: d.join(F.broadcast(wide)).withColumn(  # noqa: E731 - one row, as long as a vector
        "features", array_to_vector(F.zip_with(vector, "_z", lambda x, z: (x.cast("double") - z["m"]) / (z["s"] + F.lit(1e-6))))
    ).drop("_z")
    return [scale(d) for d in (train, *others)]


def probe(train: DataFrame, test: DataFrame, label: str = "label", c: float = 1.0, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, true, pred) of a linear probe: multinomial logistic regression with penalty 1 / (c n) on standardised vectors.

    Empty if the training labels have fewer than two values. Test labels that training lacks stay as true labels.
    """
    names = train.select(label).distinct().limit(2).count()
    if names < 2:
        return test.select(*keep, F.col(label).alias("a"), F.col(label).alias("b")).limit(0)
    train = train.cache()
    a, b = standardised(train, [test])
    index = StringIndexer(inputCol=label, outputCol="_y", handleInvalid="keep").fit(a)
    n = train.count()
    fitted = LogisticRegression(featuresCol="features", labelCol="_y", regParam=1 / (c * n), elasticNetParam=0, standardization=False, family="multinomial", maxIter=200).fit(index.transform(a))
    train.unpersist()
    return _named(fitted.transform(b), index.labels, label, keep)


def _named(scored: DataFrame, labels: list[str], label: str, keep: Sequence[str] = ()) -> DataFrame:
    known = F.array(*(F.lit(x) for x in labels))
    return scored.select(*keep, F.col(label).cast("string").alias("a"), F.get(known, F.col("prediction").cast("int")).alias("b"))


def probe_kappa(train: DataFrame, test: DataFrame, label: str = "label", c: float = 1.0) -> float | None:
    """Cohen's kappa of the probe; None without two classes."""
    row = cohen_kappa(probe(train, test, label, c), []).first() if train.select(label).distinct().count() > 1 else None
    return row["kappa"] if row else None


def probe_relabel(known: DataFrame, pool: DataFrame, attributes: Sequence[str], seed: int = 0, c: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """((set, id, attr, value) predicted labels, (attr, heldout_kappa, heldout_jsd, carried_kappa)) of one probe per attribute.

    Each probe learns the attribute from half of ``known`` (id, vector, attributes) and labels its other half, set 'target', and
    the whole pool, set 'pool', so that both pass through the same classifier. ``carried_kappa`` compares the pool's own
    labels, where it has the attribute, with the predicted ones.
    """
    halves = half_split(known, "id", seed).cache()
    labels, quality = [], []
    for a in attributes:
        train, held = (halves.where(F.col("split") == s).select("id", "vector", F.col(a).alias("label")) for s in ("ref", "query"))
        own = pool.select("id", "vector", F.col(a).alias("label") if a in pool.columns else F.lit(None).cast("string").alias("label"))
        both = held.withColumn("set", F.lit("target")).unionByName(own.withColumn("set", F.lit("pool")))
        scored = probe(train.where("label is not null"), both, c=c, keep=("set", "id")).withColumn("attr", F.lit(a))
        labels.append(scored.select("set", "id", "attr", F.col("b").alias("value")))
        quality.append(scored)
    every = reduce(DataFrame.unionByName, quality)
    kappas = cohen_kappa(every, ["attr", "set"])
    at = lambda s: F.max(F.when(F.col("set") == s, F.col("kappa")))
    side = lambda col: every.where("set = 'target' and a is not null").select("attr", F.col(col).alias("value"))
    jsd = jensen_shannon(side("b"), side("a"), ["attr"]).withColumnRenamed("jsd", "heldout_jsd")
    found = kappas.groupBy("attr").agg(at("target").alias("heldout_kappa"), at("pool").alias("carried_kappa")).join(jsd, "attr", "left")
    return reduce(DataFrame.unionByName, labels), found.select("attr", "heldout_kappa", "heldout_jsd", "carried_kappa")


def tfidf_pipeline(text: str = "text", min_df: int = 2, most: int = 200_000) -> Pipeline:
    """Words and word pairs with 1 + ln tf, ln((1 + n) / (1 + df)) + 1 and unit rows. ``fit`` must see the training texts only."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"\b\w\w+\b", gaps=False, toLowercase=True),
        NGram(n=2, inputCol="_w", outputCol="_b"),
        SQLTransformer(statement="SELECT *, concat(_w, _b) AS _g FROM __THIS__"),
        CountVectorizer(inputCol="_g", outputCol="_tf", minDF=min_df, vocabSize=most),
    ])


def tfidf_classifier(train: DataFrame, validation: DataFrame, test: DataFrame, label: str = "label", text: str = "text", grid: tuple = (0.3, 1.0, 3.0, 10.0)) -> tuple[DataFrame, float]:
    """((true, pred) of the test rows, chosen C): logistic regression on TF-IDF, C by the validation kappa."""
    train = train.select(label, text).cache()
    pipe = tfidf_pipeline(text).fit(train)
    counted = lambda d: pipe.transform(d).select(*d.columns, "_tf")
    own = counted(train).cache()
    idf = IDF(inputCol="_tf").fit(own)
    # A sparse vector has no elementwise logarithm in the JVM, so this one step runs in Python, on non-zero entries only.
    damp = F.udf(lambda v: Vectors.sparse(v.size, v.indices, 1 + np.log(v.values)), VectorUDT())
    weigh = ElementwiseProduct(scalingVec=Vectors.dense(idf.idf.toArray() + 1), inputCol="_t", outputCol="_i")
    unit = Normalizer(inputCol="_i", outputCol="features")
    ready = lambda d: unit.transform(weigh.transform(d.withColumn("_t", damp("_tf")))).drop("_tf", "_t", "_i", text)
    index = StringIndexer(inputCol=label, outputCol="_y", handleInvalid="keep").fit(train)
    n = train.count()
    # Every task of an iteration sends a gradient as long as the vocabulary, so tasks get a few thousand rows each.
    a = index.transform(ready(own)).coalesce(max(1, n // 4000)).cache()
    v = ready(counted(validation.select(label, text))).cache()
    best = None
    for c in grid:
        m = LogisticRegression(labelCol="_y", regParam=1 / (c * n), elasticNetParam=0, standardization=False, family="multinomial", maxIter=100).fit(a)
        k = cohen_kappa(_named(m.transform(v), index.labels, label), []).first()
        kappa = k["kappa"] if k and k["kappa"] is not None else -1.0
        if best is None or kappa > best[0]:
            best = (kappa, c, m)
    for d in (a, v, own, train):
        d.unpersist()
    return _named(best[2].transform(ready(counted(test))), index.labels, label), best[1]


def text_classifier(train: DataFrame, label: str = "label", text: str = "text", c: float = 1.0, min_df: int = 2) -> PipelineModel:
    """A fitted text classifier that can be saved: counts of words and word pairs, inverse document frequencies, unit rows, logistic regression."""
    index = StringIndexer(inputCol=label, outputCol="_y", handleInvalid="keep")
    stages = [*tfidf_pipeline(text, min_df).getStages(), IDF(inputCol="_tf", outputCol="_i"), Normalizer(inputCol="_i", outputCol="features"), index]
    fit = LogisticRegression(labelCol="_y", regParam=1 / (c * max(train.count(), 1)), elasticNetParam=0, standardization=False, family="multinomial", maxIter=100)
    return Pipeline(stages=[*stages, fit]).fit(train)


def predictor(model: PipelineModel, label: str = "label") -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``prediction_label`` to texts."""
    names = F.array(*(F.lit(x) for x in model.stages[-2].labels))

    def predict(df: DataFrame) -> DataFrame:
        held = df.columns
        scored = model.transform(df.withColumn(label, F.lit(None).cast("string")) if label not in held else df)
        return scored.select(*held, F.get(names, F.col("prediction").cast("int")).alias("prediction_label"))

    return predict


def save_model(model: PipelineModel, path: str) -> None:
    """Writes a fitted pipeline, replacing what is there."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def perceptron(train: DataFrame, test: DataFrame, label: str = "label", hidden: tuple = (256, 256), seed: int = 0) -> DataFrame:
    """(true, pred) of a multilayer perceptron on standardised vectors."""
    a, b = standardised(train, [test])
    index = StringIndexer(inputCol=label, outputCol="_y", handleInvalid="keep").fit(a)
    size = len(train.select("vector").first()[0])
    m = MultilayerPerceptronClassifier(labelCol="_y", layers=[size, *hidden, len(index.labels) + 1], seed=seed, maxIter=100).fit(index.transform(a))
    return _named(m.transform(b), index.labels, label)


def divergence_score(p: DataFrame, q: DataFrame, clusters: int = 16, scale: float = 5.0, seed: int = 0, points: int = 25) -> float:
    """Area under the divergence frontier of two vector collections, quantised together by k-means.

    The published frontier of exp(-scale KL) over mixtures of the two histograms; 1 for equal ones.
    """
    both = p.select("vector", F.lit(0).alias("side")).unionByName(q.select("vector", F.lit(1).alias("side")))
    ready = both.withColumn("features", array_to_vector(F.col("vector").cast("array<double>")))
    model = KMeans(k=clusters, seed=seed, maxIter=50).fit(ready)
    rows = model.transform(ready).groupBy("prediction", "side").count().collect()
    h = np.zeros((2, clusters))
    for r in rows:
        h[r["side"], r["prediction"]] = r["count"]
    h = (h + 1e-12) / (h + 1e-12).sum(axis=1, keepdims=True)
    kl = lambda x, y: float((x * np.log(np.maximum(x, 1e-300) / y)).sum())
    curve = [(1.0, 0.0), (0.0, 1.0)]
    for lam in np.linspace(1e-6, 1 - 1e-6, points):
        mix = lam * h[0] + (1 - lam) * h[1]
        curve.append((np.exp(-scale * kl(h[1], mix)), np.exp(-scale * kl(h[0], mix))))
    curve.sort(key=lambda c: (c[0], -c[1]))
    x, y = np.array(curve).T
    return float(((x[1:] - x[:-1]) * (y[1:] + y[:-1]) / 2).sum())
