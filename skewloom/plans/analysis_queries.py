"""Queries of whole analyses: visibility by repeats, correction by votes, evaluation, drift."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashrng import normal_sql, uniform_sql
from ..operators.analysis import blind_table as least_seen
from ..operators.analysis import drift_summary, evaluate, group_kappa, length_null, twin_rate as rate_of_twins
from ..operators.analysis import two_stage, vote_concentration as concentration
from ..operators.analysis import vote_correction as correct_by_votes
from ..operators.histograms import bin_among, decile_edges
from ..operators.knn import nearest, vote_histogram
from ..operators.ml import probe_kappa, probe_relabel as relabel
from ..operators.report import metric_columns as columns_of_metrics
from ..operators.report import unpivot, visibility_summary
from ..operators.splits import half_split
from . import data
from .catalog import query
from .distributions_queries import _PAIRS, _pairs, jsd_sql
from .labels_queries import _KAPPA, _rounded
from .reports_queries import _UNPIVOT
from .texts_queries import _BASE, _FEATURE_SQL
from .vectors_queries import _LABELS_SQL, K, _labels

REPEATS = 5

# Random halves of the vectors, once per repeat; a repeat is part of every id and class, so that all repeats are one plan.


def _halves(spark, sf_dir) -> DataFrame:
    v = data.vectors(spark, sf_dir)
    parts = [half_split(v, "id", seed=r).withColumn("repeat", F.lit(r)) for r in range(REPEATS)]
    own = reduce(DataFrame.unionByName, parts).withColumn("of", F.col("id"))
    return own.select((F.col("id") * 8 + F.col("repeat")).alias("id"), "of", "repeat", (F.col("repeat") * 10 + F.col("class")).alias("group"), "vector", (F.col("split") == "query").alias("is_query"))


def _kappas(halves: DataFrame, labels: DataFrame) -> DataFrame:
    """(attr, repeat, kappa) within classes."""
    found = nearest(halves.where("is_query"), halves.where("not is_query"), K, by="group")
    own = halves.select("id", "of", "repeat").join(labels.withColumnRenamed("id", "of"), "of").drop("of")
    return group_kappa(found, own, halves.select("id", "group", "is_query"), ["attr", "repeat"])


_HALVES_SQL = "halves AS (" + " UNION ALL ".join(
    f"SELECT id * 8 + {r} AS id, id AS base, {r} AS repeat, {r * 10} + class AS grp, vector, row_number() OVER (ORDER BY {uniform_sql(r, 'half', 'id')}, id) > count(*) OVER () // 2 AS is_query FROM vectors" for r in range(REPEATS)
) + "), qs AS (SELECT * FROM halves WHERE is_query), rs AS (SELECT * FROM halves WHERE NOT is_query)"
_KAPPAS_SQL = [
    data.VECTORS_SQL, _LABELS_SQL, _HALVES_SQL, data.nearest_sql("nn", K, "qs", "rs", by="grp"),
    "lb AS (SELECT h.id, repeat, grp, attr, value FROM halves h JOIN lab ON lab.id = h.base)",
    "each AS (SELECT q.attr, q.repeat, query_id, avg((q.value = r.value)::INTEGER) AS a FROM nn JOIN lb q ON q.id = query_id JOIN lb r ON r.id = ref_id AND r.attr = q.attr GROUP BY ALL)",
    "nq AS (SELECT grp, count(*) FILTER (is_query) AS n FROM halves GROUP BY grp HAVING count(*) FILTER (NOT is_query) > 0)",
    "pv AS (SELECT attr, repeat, grp, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY attr, repeat, grp) AS p FROM lb GROUP BY attr, repeat, grp, value)",
    "ch AS (SELECT attr, repeat, sum(n * chance) / sum(n) AS c FROM (SELECT attr, repeat, grp, sum(p * p) AS chance FROM pv GROUP BY ALL) JOIN nq USING (grp) GROUP BY attr, repeat)",
    "kappas AS (SELECT attr, repeat, CASE WHEN c < 1 THEN (a - c) / (1 - c) END AS kappa FROM (SELECT attr, repeat, avg(a) AS a FROM each GROUP BY attr, repeat) JOIN ch USING (attr, repeat))",
]


@query(data.ctes(*_KAPPAS_SQL) + ", g AS (SELECT attr, avg(kappa) AS k, stddev_samp(kappa) AS sd FROM kappas GROUP BY attr) SELECT attr, round(k, 6) AS knn_kappa, round(sd, 6) AS sd, row_number() OVER (ORDER BY k, attr)::INTEGER AS place FROM g")
def blind_table(spark, sf_dir):
    """Attributes by how little neighbours within classes show of them, over five random halves."""
    return _rounded(least_seen(_kappas(_halves(spark, sf_dir), _labels(spark, sf_dir))))


@query(data.ctes(*_KAPPAS_SQL) + ", r AS (SELECT repeat, avg(kappa) AS v FROM kappas WHERE kappa IS NOT NULL GROUP BY repeat) SELECT round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, count(*) AS n FROM r")
def two_stage_kappa(spark, sf_dir):
    """Mean kappa over attributes per repeat, then mean and deviation over repeats."""
    return _rounded(two_stage(_kappas(_halves(spark, sf_dir), _labels(spark, sf_dir)), [], value="kappa"))


@query(data.ctes(data.VECTORS_SQL, data.nearest_sql("nn", 1)) + "SELECT round(avg((q.label = r.label)::INTEGER), 6) AS twin_rate FROM nn JOIN vectors q ON q.id = query_id JOIN vectors r ON r.id = ref_id")
def twin_rate(spark, sf_dir):
    """How often the nearest neighbour is of the same group."""
    found = nearest(*data.voters_and_candidates(spark, sf_dir), 1)
    return _rounded(rate_of_twins(found, data.vectors(spark, sf_dir).select("id", "label")))


@query(data.ctes(data.VECTORS_SQL, data.nearest_sql("nn", 1)) + """, h AS (SELECT ref_id, count(*) AS votes FROM nn GROUP BY 1), t AS (SELECT votes, row_number() OVER (ORDER BY votes DESC, ref_id) AS r FROM h)
SELECT count(*) AS with_votes, max(votes) AS most, round(sum(votes) FILTER (r <= 20)::DOUBLE / sum(votes), 9) AS top_share FROM t""")
def vote_concentration(spark, sf_dir):
    """Candidates with votes, the most votes, and the share that the 20 best hold."""
    votes = vote_histogram(*data.voters_and_candidates(spark, sf_dir))
    return concentration(votes, 20).withColumn("top_share", F.round("top_share", 9))


# the vote's share of the way from a random selection to the target

SIGMA = 2.5788


def _chosen_sql(name: str, source: str, seed: int, runs: str) -> str:
    key = "kind || '/' || rep || '/' || id"
    score = f"CASE WHEN kind = 'random' THEN {uniform_sql(seed, 'random', key)} WHEN kind = 'vote0' THEN votes::DOUBLE ELSE round(votes + {SIGMA}::DOUBLE * {normal_sql(seed, 'select', key)}, 9) END"
    return f"{name} AS (SELECT kind, rep, id FROM (SELECT kind, rep, id, row_number() OVER (PARTITION BY kind, rep ORDER BY {score} DESC, id) AS r FROM {source}, {runs}), kk WHERE r <= k)"


_RANDOM = f"(SELECT 'random' AS kind, unnest(range(0, {REPEATS})) AS rep)"
_CORRECTION_SQL = [
    data.VECTORS_SQL, data.nearest_sql("nn", 1), _LABELS_SQL, "kk AS (SELECT count(*) // 4 AS k FROM cands)",
    "hist AS (SELECT c.id, coalesce(n, 0) AS votes FROM cands c LEFT JOIN (SELECT ref_id AS id, count(*) AS n FROM nn GROUP BY 1) USING (id))",
    "ids AS (SELECT id, 0 AS votes FROM voters)",
    _chosen_sql("sel", "hist", 0, f"({_RANDOM} UNION ALL SELECT 'vote0', 0 UNION ALL SELECT 'vote{SIGMA}', unnest(range(0, {REPEATS}))) AS runs"),
    _chosen_sql("flo", "ids", 1, f"{_RANDOM} AS runs"),
    """p AS (SELECT kind, rep, attr, value FROM sel JOIN lab USING (id) UNION ALL SELECT 'floor', rep, attr, value FROM flo JOIN lab USING (id)
    UNION ALL SELECT 'pool', 0, attr, value FROM lab WHERE id IN (SELECT id FROM cands))""",
    "q AS (SELECT kind, rep, attr, value FROM lab, (SELECT DISTINCT kind, rep FROM p) WHERE id IN (SELECT id FROM voters))",
    f"j AS (SELECT kind, rep, attr, jsd FROM {jsd_sql('p', 'q', 'kind, rep, attr')})",
]


def _one_sigma(s: str) -> str:
    of = lambda k, f="avg": f"{f}(jsd) FILTER (kind = '{k}')"
    return f"SELECT {s}::DOUBLE AS sigma, attr, {of('pool')} AS pool, {of('random')} AS random, {of('random', 'stddev_pop')} AS random_sd, {of('floor')} AS floor, {of('vote' + s)} AS vote FROM j GROUP BY attr"


@query(data.ctes(*_CORRECTION_SQL) + f"SELECT sigma, attr, {', '.join(f'round({c}, 6) AS {c}' for c in ('pool', 'random', 'random_sd', 'floor', 'vote'))}, round(CASE WHEN random - floor > 2 * random_sd THEN (random - vote) / (random - floor) END, 6) AS correction FROM ({_one_sigma('0')} UNION ALL {_one_sigma(str(SIGMA))})")
def vote_correction(spark, sf_dir):
    """How much of a random selection's distance to the voters' labels the vote removes, with and without noise."""
    voters, cands = data.voters_and_candidates(spark, sf_dir)
    labels = _labels(spark, sf_dir)
    votes = vote_histogram(voters, cands).withColumnRenamed("cand_id", "id")
    of = lambda d: labels.join(d.select("id"), "id", "left_semi")
    return _rounded(correct_by_votes(votes, of(cands), of(voters), cands.count() // 4, REPEATS, (0.0, SIGMA)))


@query()
def probe_relabel(spark, sf_dir):
    """Held-out kappa, marginal distance and agreement with carried labels of probes that label the candidates: fitted, so without SQL."""
    voters, cands = data.voters_and_candidates(spark, sf_dir)
    named = lambda d: d.withColumns({"digit": F.col("label").cast("string"), "parity": (F.col("label") % 2).cast("string")})
    return relabel(named(voters), named(cands), ["digit", "parity"])[1]


@query()
def exp1_visibility(spark, sf_dir):
    """Visibility of three attributes by neighbours and by linear probes over two halves: fitted, so without SQL."""
    labels, v, rows = _labels(spark, sf_dir), data.vectors(spark, sf_dir), []
    for r in range(2):
        half = half_split(v.drop("label"), "id", seed=r)
        for attr in ("label", "parity", "absent"):
            own = half.join(labels.where(F.col("attr") == attr).select("id", F.col("value").alias("label")), "id")
            rows.append((attr, r, probe_kappa(own.where("split = 'ref'"), own.where("split = 'query'"))))
    knn = _kappas(_halves(spark, sf_dir).where("repeat < 2"), labels).select("attr", "repeat", F.col("kappa").alias("knn"))
    per = knn.join(spark.createDataFrame(rows, "attr string, repeat int, probe double"), ["attr", "repeat"])
    return visibility_summary(per, labels.groupBy("attr").agg(F.count_distinct("value").alias("n_classes")), 1)


# an annotator's labels against the carried ones

_EVALUATION = [
    *_PAIRS, "cells AS (SELECT attr, a, b, count(*) AS c FROM pairs GROUP BY ALL)", f"kap AS ({_KAPPA})",
    "tt AS (SELECT attr, a AS v, count(*) AS t, count(*) FILTER (a = b) AS tp FROM pairs GROUP BY ALL), qq AS (SELECT attr, b AS v, count(*) AS q FROM pairs GROUP BY ALL)",
    "f1 AS (SELECT attr, sum(tp)::DOUBLE / sum(t) AS accuracy, avg(2.0::DOUBLE * tp / (t + coalesce(q, 0))) AS macro_f1 FROM tt LEFT JOIN qq USING (attr, v) GROUP BY attr)",
    "true_ AS (SELECT row_id, attr, a AS value FROM (SELECT row_id, attr, q.value AS a FROM qlong q JOIN mlong m USING (row_id, attr) WHERE m.value IS NOT NULL))",
    "pred_ AS (SELECT attr, b AS value FROM pairs)",
    "cum AS (SELECT attr, value, round(sum(n) OVER (PARTITION BY attr ORDER BY value ROWS UNBOUNDED PRECEDING)::DOUBLE / sum(n) OVER (PARTITION BY attr), 12) AS c FROM (SELECT attr, value, count(*) AS n FROM true_ GROUP BY ALL))",
    "steps AS (SELECT attr, value, coalesce(lag(c) OVER (PARTITION BY attr ORDER BY c, value), 0) AS lo, CASE WHEN row_number() OVER (PARTITION BY attr ORDER BY c DESC, value DESC) = 1 THEN 2 ELSE c END AS hi FROM cum)",
    f"draws AS (SELECT attr, rep, {uniform_sql(0, 'floor', chr(39).join(['rep || ', '/', ' || attr || ', '/', ' || row_id']))} AS u FROM true_, (SELECT unnest(range(0, 20)) AS rep))",
    "again AS (SELECT d.attr, rep, value FROM draws d JOIN steps s ON s.attr = d.attr AND u >= lo AND u < hi), goal_ AS (SELECT attr, rep, value FROM true_, (SELECT unnest(range(0, 20)) AS rep))",
    f"flo AS (SELECT attr, avg(jsd) AS floor FROM {jsd_sql('again', 'goal_', 'attr, rep')} GROUP BY attr)", f"raw_ AS (SELECT attr, jsd FROM {jsd_sql('pred_', 'true_')})",
]


def _evaluation(spark, sf_dir):
    classes = data.table(spark, sf_dir, "schema_options").select("attr", F.col("option_value").alias("value"))
    return evaluate(_pairs(spark, sf_dir).withColumnRenamed("row_id", "id"), classes)


@query(data.ctes(*_EVALUATION) + "SELECT attr, n, kappa, round(macro_f1, 6) AS macro_f1, round(accuracy, 6) AS accuracy, round(jsd, 6) AS marginal_jsd, round(floor, 6) AS marginal_jsd_floor FROM kap JOIN f1 USING (attr) JOIN raw_ USING (attr) JOIN flo USING (attr)")
def classifier_evaluation(spark, sf_dir):
    """Quality of the annotated labels against the carried ones, with the floor of resampled true labels."""
    return _rounded(_evaluation(spark, sf_dir).drop("marginal_jsd_corrected"))


@query()
def classifier_evaluation_corrected(spark, sf_dir):
    """The same with the marginal distance after correction by confusion: least squares, so without SQL."""
    return _rounded(_evaluation(spark, sf_dir))


# drift


@query(data.ctes(data.RUNLOG_SQL, f"u AS {_UNPIVOT.format(src='logs')}", "pr AS (SELECT annotator, metric, lam, seed, max(value) FILTER (round = 0) AS a, max(value) FILTER (round = 3) AS b FROM u GROUP BY ALL)")
    + "SELECT annotator, metric, round(avg(a), 6) AS first, round(avg(b), 6) AS last, round(avg(b - a), 6) AS change, round(stddev_samp(b - a) / sqrt(count(*)), 6) AS se, count(*) AS n FROM pr WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY annotator, metric")
def drift_round0_round3(spark, sf_dir):
    """Mean change of every metric from round 0 to round 3 over paired runs, with its standard error."""
    long = unpivot(data.run_log(spark, sf_dir), ["annotator", "lam", "seed", "round"], data.METRICS)
    return _rounded(drift_summary(long, ["annotator", "metric"], ["lam", "seed"], 3))


_SHAPES = ("numeric_rate", "mean_word_length", "mean_sentence_length")
_SHAPE_COLUMNS = ", ".join(f"round({_FEATURE_SQL[c]}, 6) AS {c}" for c in _SHAPES)


def _shape_sql(name: str, source: str, more: str) -> str:
    """``name`` AS a row per text and feature; floors of 50 words."""
    body = _BASE.replace("SELECT row_id, text AS t FROM pool WHERE text IS NOT NULL", f"SELECT row_id, text AS t{more} FROM {source} WHERE text IS NOT NULL")
    wide = f"(WITH {body} SELECT row_id{more and ', arm'}, floor(white / 50.0::DOUBLE)::INTEGER AS length_bin, {_SHAPE_COLUMNS} FROM b)"
    parts = " UNION ALL ".join(f"SELECT row_id{more and ', arm'}, length_bin, '{c}' AS attr, {c} AS x FROM w" for c in _SHAPES)
    return f"{name} AS (WITH w AS {wide} {parts})"


_LENGTH_SQL = [
    data.PRIVATE_SQL, data.POOL_SQL, _shape_sql("real0", "private", ""), _shape_sql("rows0", "pool1", ", CASE WHEN parent_row_id IS NULL THEN 'prompt' ELSE 'variation' END AS arm"),
    "edges AS (SELECT attr, list_sort(list_distinct(list_transform(quantile_cont(x::DOUBLE, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]), lambda e: round(e, 9)))) AS edges FROM real0 GROUP BY attr)",
    "real_ AS (SELECT row_id, attr, length_bin, len(list_filter(edges, lambda e: e <= x))::INTEGER AS bin FROM real0 JOIN edges USING (attr))",
    "rows_ AS (SELECT row_id, arm, attr, length_bin, len(list_filter(edges, lambda e: e <= x))::INTEGER AS bin FROM rows0 JOIN edges USING (attr))",
    "have AS (SELECT DISTINCT attr, length_bin AS near FROM real_)",
    "near_ AS (SELECT attr, length_bin, arg_min(near, abs(near - length_bin) * 10000 + near) AS near FROM (SELECT DISTINCT attr, length_bin FROM rows_) JOIN have USING (attr) GROUP BY attr, length_bin)",
    "cum AS (SELECT attr, length_bin AS near, bin, round(sum(n) OVER (PARTITION BY attr, length_bin ORDER BY bin ROWS UNBOUNDED PRECEDING)::DOUBLE / sum(n) OVER (PARTITION BY attr, length_bin), 12) AS c FROM (SELECT attr, length_bin, bin, count(*) AS n FROM real_ GROUP BY ALL))",
    "steps AS (SELECT attr, near, bin, coalesce(lag(c) OVER (PARTITION BY attr, near ORDER BY c, bin), 0) AS lo, CASE WHEN row_number() OVER (PARTITION BY attr, near ORDER BY c DESC, bin DESC) = 1 THEN 2 ELSE c END AS hi FROM cum)",
    f"draws AS (SELECT arm, attr, near, rep, {uniform_sql(0, 'length', chr(39).join(['rep || ', '/', ' || attr || ', '/', ' || row_id']))} AS u FROM rows_ JOIN near_ USING (attr, length_bin), (SELECT unnest(range(0, 10)) AS rep))",
    "again AS (SELECT d.arm, d.attr, rep, bin AS value FROM draws d JOIN steps s ON s.attr = d.attr AND s.near = d.near AND u >= lo AND u < hi)",
    "goal_ AS (SELECT arm, attr, bin AS value FROM real_, (SELECT DISTINCT arm FROM rows_)), goalr AS (SELECT arm, attr, rep, value FROM goal_, (SELECT unnest(range(0, 10)) AS rep)), seen_ AS (SELECT arm, attr, bin AS value FROM rows_)",
]


@query(data.ctes(*_LENGTH_SQL) + f'SELECT arm, attr, round(jsd, 6) AS jsd, round("null", 6) AS "null", round(jsd - "null", 6) AS excess FROM {jsd_sql("seen_", "goal_", "arm, attr")} JOIN (SELECT arm, attr, avg(jsd) AS "null" FROM {jsd_sql("again", "goalr", "arm, attr, rep")} GROUP BY ALL) USING (arm, attr)')
def length_null_excess(spark, sf_dir):
    """Distance of three features of pool texts to private ones, beyond what their lengths alone explain."""
    arm = F.when(F.col("parent_row_id").isNull(), "prompt").otherwise("variation").alias("arm")
    real = data.private(spark, sf_dir, "text").where("text is not null").select(F.col("row_id").alias("id"), "text")
    rows = data.pool(spark, sf_dir, "text", "parent_row_id").where("text is not null").select(F.col("row_id").alias("id"), arm, "text")
    found = T.features(F.col("text"))
    wide = lambda d: d.withColumns({"length_bin": F.floor(found["word_count"] / F.lit(50.0)).cast("int"), **{c: F.round(found[c], 6) for c in _SHAPES}}).drop("text")
    real, rows = wide(real), wide(rows)
    edges = {c: sorted({round(e, 9) for e in own}) for c, own in decile_edges(real, _SHAPES).items()}
    long = lambda d, ids: d.select(*ids, F.inline(F.array(*(F.struct(F.lit(c).alias("attr"), bin_among(F.col(c), edges[c]).alias("bin")) for c in _SHAPES))))
    return _rounded(length_null(long(rows, ["id", "arm", "length_bin"]), long(real, ["id", "length_bin"]), ["arm"]))


@query("SELECT column_name AS metric FROM (DESCRIBE SELECT * FROM run_log) WHERE column_type IN ('DOUBLE', 'FLOAT', 'INTEGER', 'BIGINT') AND (starts_with(column_name, 'jsd_') OR starts_with(column_name, 'mauve'))")
def metric_columns(spark, sf_dir):
    """The log's metric columns, found by prefix and type."""
    return spark.createDataFrame([(m,) for m in columns_of_metrics(data.table(spark, sf_dir, "run_log"))], "metric string")
