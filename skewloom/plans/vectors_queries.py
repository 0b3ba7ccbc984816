"""Queries of the vector family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vector import doubles, dot, layer_norm, norm, unit
from ..functions.hashrng import uniform, uniform_sql
from ..operators.agreement import neighbour_kappa
from ..operators.histograms import nearest_bin
from ..operators.knn import lost_votes, nearest, recall_between, vote_histogram
from . import data
from .catalog import query

K = 5


def _sets(spark, sf_dir):
    return data.voters_and_candidates(spark, sf_dir)


@query(data.ctes(data.VECTORS_SQL, data.nearest_sql("nn", 1)) + "SELECT c.id AS cand_id, coalesce(n, 0) AS votes FROM cands c LEFT JOIN (SELECT ref_id AS id, count(*) AS n FROM nn GROUP BY 1) USING (id)")
def nn1_vote_hist(spark, sf_dir):
    """Votes of every candidate: each voter for its nearest."""
    return vote_histogram(*_sets(spark, sf_dir))


@query(data.ctes(data.VECTORS_SQL, data.nearest_sql("nn", K)) + "SELECT query_id, ref_id, rank, round(distance, 6) AS distance FROM nn")
def knn5_neighbours(spark, sf_dir):
    """The five nearest candidates of every voter."""
    return nearest(*_sets(spark, sf_dir), K).withColumn("distance", F.round("distance", 6))


_LABELS_SQL = f"lab AS (SELECT id, 'label' AS attr, label::VARCHAR AS value FROM vectors UNION ALL SELECT id, 'parity', (label % 2)::VARCHAR FROM vectors UNION ALL SELECT id, 'absent', floor({uniform_sql(3, 'absent', 'id')} * 4)::VARCHAR FROM vectors)"


def _labels(spark, sf_dir):
    """A visible, a weak and an absent attribute of every vector."""
    absent = F.floor(uniform(3, "absent", F.col("id")) * 4)
    named = (("label", F.col("label")), ("parity", F.col("label") % 2), ("absent", absent))
    return data.vectors(spark, sf_dir).select("id", F.inline(F.array(*(F.struct(F.lit(a).alias("attr"), c.cast("string").alias("value")) for a, c in named))))


@query(data.ctes(data.VECTORS_SQL, data.nearest_sql("nn", K), _LABELS_SQL) + """, ag AS (SELECT attr, avg((q.value = r.value)::INTEGER) AS agree FROM nn JOIN lab q ON q.id = query_id JOIN lab r ON r.id = ref_id AND r.attr = q.attr GROUP BY 1 ) ,
ch AS (SELECT attr, sum(p * p) AS chance FROM (SELECT attr, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY attr) AS p FROM lab GROUP BY attr, value) GROUP BY attr)
SELECT attr, round(agree, 6) AS agree, round(chance, 6) AS chance, round((agree - chance) / (1 - chance), 6) AS kappa FROM ag JOIN ch USING (attr)""".replace("SELECT attr, avg((q", "SELECT q.attr AS attr, avg((q"))
def knn_kappa(spark, sf_dir):
    """Visibility of three attributes to the neighbourhoods."""
    k = neighbour_kappa(nearest(*_sets(spark, sf_dir), K), _labels(spark, sf_dir))
    return k.select("attr", *(F.round(c, 6).alias(c) for c in ("agree", "chance", "kappa")))


@query(data.ctes(data.VECTORS_SQL, data.nearest_sql("nn", 1, by="class")) + "SELECT c.id AS cand_id, coalesce(n, 0) AS votes FROM cands c LEFT JOIN (SELECT ref_id AS id, count(*) AS n FROM nn GROUP BY 1) USING (id)")
def class_vote(spark, sf_dir):
    """Votes within classes."""
    return vote_histogram(*_sets(spark, sf_dir), by="class")


_FINE = f"fine AS (SELECT voter, floor({uniform_sql(5, 'fine', 'id')} * 997)::BIGINT AS class FROM vectors)"


@query(data.ctes(data.VECTORS_SQL, _FINE) + "SELECT class, count(*) AS votes FROM fine WHERE voter AND class NOT IN (SELECT class FROM fine WHERE NOT voter) GROUP BY 1")
def lost_votes_by_class(spark, sf_dir):
    """Votes that are lost as their class, one of 997, has no candidate."""
    own = data.vectors(spark, sf_dir).select("voter", F.floor(uniform(5, "fine", F.col("id")) * 997).alias("class"))
    return lost_votes(own.where("voter"), own.where("not voter"), "class")


@query(data.ctes(data.VECTORS_SQL, data.nearest_sql("nn", K, by="class"), _LABELS_SQL) + """, l AS (SELECT lab.*, class FROM lab JOIN vectors USING (id)), ag AS (SELECT q.attr, q.class, avg((q.value = r.value)::INTEGER) AS agree FROM nn JOIN l q ON q.id = query_id JOIN l r ON r.id = ref_id AND r.attr = q.attr GROUP BY 1, 2),
ch AS (SELECT attr, class, sum(p * p) AS chance FROM (SELECT attr, class, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY attr, class) AS p FROM l GROUP BY attr, class, value) GROUP BY attr, class),
n AS (SELECT class, count(*) AS n FROM voters WHERE class IN (SELECT class FROM cands) GROUP BY 1)
SELECT attr, round((sum(n * agree) / sum(n) - sum(n * chance) / sum(n)) / (1 - sum(n * chance) / sum(n)), 6) AS kappa FROM ag JOIN ch USING (attr, class) JOIN n USING (class) GROUP BY attr HAVING sum(n * chance) / sum(n) < 1""")
def within_class_kappa(spark, sf_dir):
    """Kappa inside classes; agreement and chance are weighted by the classes' queries."""
    voters, cands = _sets(spark, sf_dir)
    classes = data.vectors(spark, sf_dir).select("id", "class")
    labels = _labels(spark, sf_dir).join(classes, "id")
    found = nearest(voters, cands, K, by="class")
    per = neighbour_kappa(found, labels, ["attr", "class"])
    n = voters.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    w = lambda c: F.sum(F.col("n") * F.col(c)) / F.sum("n")
    out = per.join(F.broadcast(n), "class").groupBy("attr").agg(w("agree").alias("a"), w("chance").alias("c"))  # a row per class
    return out.where("c < 1").select("attr", F.round((F.col("a") - F.col("c")) / (1 - F.col("c")), 6).alias("kappa"))


_SHORT = "short AS (SELECT id, list_slice(vector, 1, 16) AS vector FROM vectors), sv AS (SELECT short.* FROM short JOIN voters USING (id)), sc AS (SELECT short.* FROM short JOIN cands USING (id))"


@query(data.ctes(data.VECTORS_SQL, _SHORT, data.nearest_sql("a", 10), data.nearest_sql("b", 10, "sv", "sc")) + "SELECT query_id, count(b.ref_id) / 10.0::DOUBLE AS recall FROM a LEFT JOIN b USING (query_id, ref_id) GROUP BY 1")
def recall_at_10(spark, sf_dir):
    """Neighbours that survive in the first 16 dimensions."""
    voters, cands = _sets(spark, sf_dir)
    short = lambda d: d.withColumn("vector", F.slice("vector", 1, 16))
    return recall_between(nearest(voters, cands, 10), nearest(short(voters), short(cands), 10), 10)


@query(data.ctes(data.VECTORS_SQL) + """, p AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(vector) AS x FROM vectors) GROUP BY 1, 2), proxies AS (SELECT label AS id, list(round(x, 9) ORDER BY i) AS vector FROM p GROUP BY label)
SELECT query_id, ref_id AS nearest FROM (SELECT v.id AS query_id, c.id AS ref_id, row_number() OVER (PARTITION BY v.id ORDER BY round(list_sum(list_transform(list_zip(v.vector, c.vector), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9), c.id) AS r FROM vectors v, proxies c) WHERE r = 1""")
def nearest_proxy(spark, sf_dir):
    """The closest class proxy (mean vector) of every vector."""
    v = data.vectors(spark, sf_dir)
    mean = v.select("label", F.posexplode("vector").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg("x"), 9).alias("x"))
    proxies = mean.groupBy(F.col("label").alias("id")).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).select("id", F.col("v.x").alias("vector"))
    return nearest(v, proxies, 1).select("query_id", F.col("ref_id").alias("nearest"))


@query(data.ctes(data.POOL_SQL, "bins AS (SELECT DISTINCT round_even(word_count / 50.0::DOUBLE, 0)::INTEGER AS bin FROM biorxiv_train_metadata WHERE word_count IS NOT NULL)", "b AS (SELECT row_id, floor(word_count / 50.0::DOUBLE)::INTEGER AS b FROM pool1 WHERE word_count IS NOT NULL)") + "SELECT row_id, (SELECT bin FROM bins ORDER BY abs(bin - b), bin LIMIT 1) AS nearest FROM b")
def nearest_bin_pool(spark, sf_dir):
    """The closest length bin that private texts have, the smaller one on ties."""
    bins = data.table(spark, sf_dir, "biorxiv_train_metadata").where("word_count is not null").select(F.bround(F.col("word_count") / F.lit(50.0)).cast("int").alias("bin"))
    rows = data.pool(spark, sf_dir, "word_count").where("word_count is not null").select("row_id", F.floor(F.col("word_count") / F.lit(50.0)).cast("int").alias("b"))
    return nearest_bin(rows, bins, "b", "bin").select("row_id", "nearest")


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), m AS (SELECT vec_id, x, list_avg(x) AS m FROM v), s AS (SELECT vec_id, list_transform(x, lambda e: (e - m)) AS c FROM m), z AS (SELECT vec_id, list_transform(c, lambda e: e / sqrt(list_dot_product(c, c) / len(c) + 1e-5)) AS z FROM s) SELECT vec_id, round(list_sum(list_transform(z, lambda e: e * e)), 4) AS squares, round(z[1] / sqrt(list_dot_product(z, z)), 6) AS first_entry FROM z")
def normalised_vectors(spark, sf_dir):
    """Layer-normalised and unit-length vectors, by their squares and first entry."""
    z = layer_norm(doubles(F.col("embedding")))
    d = data.table(spark, sf_dir, "embeddings").select("vec_id", z.alias("z"))
    return d.select("vec_id", F.round(F.pow(norm(F.col("z")), 2), 4).alias("squares"), F.round(unit(F.col("z"))[0], 6).alias("first_entry"))


@query("SELECT label, round(avg(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS mean_square FROM embeddings GROUP BY label")
def mean_square_by_label(spark, sf_dir):
    """Mean squared length of the vectors of each label."""
    v = doubles(F.col("embedding"))
    return data.table(spark, sf_dir, "embeddings").select("label", dot(v, v).alias("s")).groupBy("label").agg(F.round(F.avg("s"), 6).alias("mean_square"))
