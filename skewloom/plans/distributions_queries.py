"""Queries of the distribution family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.agreement import chance_agreement, confusion, jensen_shannon, macro_f1, mutual_information
from ..operators.analysis import corrected
from ..operators.raking import marginals
from ..operators.report import metric_means
from . import data
from .catalog import query
from .labels_queries import _MAPPED, _label_pairs, _mapped_long, _rounded


def jsd_sql(p: str, q: str, by: str = "attr") -> str:
    """(by, jsd) of two long tables (by, value)."""
    return f"""(SELECT {by}, sqrt(greatest(sum(t) / 2, 0)) AS jsd FROM (SELECT {by}, CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END AS t FROM
    (SELECT {by}, value, coalesce(p, 0) / sum(p) OVER (PARTITION BY {by}) AS p, coalesce(q, 0) / sum(q) OVER (PARTITION BY {by}) AS q FROM
    (SELECT {by}, value, count(*)::DOUBLE AS p FROM {p} WHERE value IS NOT NULL GROUP BY ALL) FULL JOIN (SELECT {by}, value, count(*)::DOUBLE AS q FROM {q} WHERE value IS NOT NULL GROUP BY ALL) USING ({by}, value))) GROUP BY {by})"""


_BOTH = [*data.PRIVATE_LONG_SQL, *data.POOL_LONG_SQL]


@query(data.ctes(*data.PRIVATE_LONG_SQL) + "SELECT attr, value, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY attr), 9) AS p FROM plong GROUP BY attr, value")
def marginals_private(spark, sf_dir):
    """Shares of every attribute's values among the private records."""
    from ..functions.labels import clean_labels

    d = clean_labels(data.private(spark, sf_dir, *data.ATTRIBUTES), data.vocabulary(spark, sf_dir), data.ATTRIBUTES)
    return marginals(d, data.ATTRIBUTES).withColumn("p", F.round("p", 9))


@query(data.ctes(*_BOTH) + f"SELECT attr, round(jsd, 6) AS jsd FROM {jsd_sql('qlong', 'plong')}")
def jsd_per_attr(spark, sf_dir):
    """Distance of pool and private records by attribute."""
    return _rounded(jensen_shannon(data.pool_long(spark, sf_dir), data.private_long(spark, sf_dir), ["attr"]))


@query(data.ctes(*_MAPPED, *data.PRIVATE_LONG_SQL[:1], *data.PRIVATE_LONG_SQL[2:]) + f"SELECT attr, round(jsd, 6) AS jsd FROM {jsd_sql('mlong', 'plong')}")
def jsd_missing_dropped(spark, sf_dir):
    """Distance of annotated pool labels and private records; missing annotations do not count."""
    return _rounded(jensen_shannon(_mapped_long(spark, sf_dir), data.private_long(spark, sf_dir), ["attr"]))


@query(data.ctes(*_BOTH, "qq AS (SELECT row_id % 40 AS part, attr, value FROM qlong)", "pp AS (SELECT part, attr, value FROM plong, (SELECT DISTINCT part FROM qq))", "j AS (SELECT part, attr, value FROM qq)")
    + f"SELECT part, attr, round(jsd, 6) AS jsd FROM {jsd_sql('qq', 'pp', 'part, attr')}")
def marginal_jsd_target(spark, sf_dir):
    """Distance to the target marginals of each of 40 slices of the pool; the slices together are the whole pool."""
    q = data.pool_long(spark, sf_dir).withColumn("part", F.col("row_id") % 40)
    counts = data.private_long(spark, sf_dir).groupBy("attr", "value").agg(F.count(F.lit(1)).alias("w"))
    parts = q.select("part").distinct()
    p = counts.join(F.broadcast(parts))  # 40 rows
    return _rounded(jensen_shannon(q.withColumn("w", F.lit(1)), p, ["part", "attr"], weight="w"))


def _cells(name: str, long: str) -> str:
    return f"{name} AS (SELECT 'cell' AS attr, max(value) FILTER (attr = 'sample_size') || '|' || max(value) FILTER (attr = 'dominant_data_type') AS value FROM {long} GROUP BY row_id)"


@query(data.ctes(*_BOTH, _cells("qc", "qlong"), _cells("pc", "plong")) + f"SELECT attr, round(jsd, 6) AS jsd FROM {jsd_sql('qc', 'pc')}")
def cell_jsd(spark, sf_dir):
    """Distance over the joint cells of two attributes."""
    from .selection_queries import candidates

    cand, goal, _ = candidates(spark, sf_dir)
    one = lambda d, w: d.select(F.lit("cell").alias("attr"), F.col("cell").alias("value"), w.alias("w"))
    return _rounded(jensen_shannon(one(cand, F.lit(1.0)), one(goal, F.col("p")), ["attr"], weight="w"))


@query(data.ctes(*data.PRIVATE_LONG_SQL) + "SELECT attr, round(sum(p * p), 9) AS chance FROM (SELECT attr, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY attr) AS p FROM plong GROUP BY attr, value) GROUP BY attr")
def chance_agreement_private(spark, sf_dir):
    """Probability that two private records agree, by attribute."""
    return chance_agreement(data.private_long(spark, sf_dir), ["attr"]).withColumn("chance", F.round("chance", 9))


_NMI = """n AS (SELECT a.attr AS attr_a, b.attr AS attr_b, a.value AS x, b.value AS y, count(*) AS n FROM plong a JOIN plong b ON a.row_id = b.row_id AND a.attr <= b.attr GROUP BY ALL),
pr AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY attr_a, attr_b) AS p FROM n), ps AS (SELECT *, sum(p) OVER (PARTITION BY attr_a, attr_b, x) AS px, sum(p) OVER (PARTITION BY attr_a, attr_b, y) AS py FROM pr),
nmi AS (SELECT attr_a, attr_b, CASE WHEN attr_a = attr_b THEN 1.0 ELSE greatest(sum(p * ln(p / (px * py))), 0) / ((-sum(p * ln(px)) - sum(p * ln(py))) / 2) END AS nmi FROM ps GROUP BY attr_a, attr_b)"""


@query(data.ctes(*data.PRIVATE_LONG_SQL, _NMI) + "SELECT attr_a, attr_b, round(nmi, 6) AS nmi FROM nmi")
def nmi_matrix(spark, sf_dir):
    """Normalised mutual information of all pairs of attributes."""
    return _rounded(mutual_information(data.private_long(spark, sf_dir), "row_id"))


@query(data.ctes(*data.PRIVATE_LONG_SQL, _NMI) + "SELECT attr, round(avg(nmi), 6) AS nmi FROM (SELECT attr_a AS attr, nmi FROM nmi WHERE attr_a <> attr_b UNION ALL SELECT attr_b, nmi FROM nmi WHERE attr_a <> attr_b) GROUP BY attr")
def nmi_offdiag_mean(spark, sf_dir):
    """Mean information that an attribute shares with the others."""
    m = mutual_information(data.private_long(spark, sf_dir), "row_id").where("attr_a <> attr_b")
    return _rounded(m.select(F.explode(F.array("attr_a", "attr_b")).alias("attr"), "nmi").groupBy("attr").agg(F.avg("nmi").alias("nmi")))


def _pairs(spark, sf_dir):
    return _label_pairs(spark, sf_dir).where("b is not null")


_PAIRS = [*_MAPPED, *data.POOL_LONG_SQL[1:], "pairs AS (SELECT attr, q.value AS a, m.value AS b FROM qlong q JOIN mlong m USING (row_id, attr) WHERE m.value IS NOT NULL)"]


@query(data.ctes(*_PAIRS) + """, g AS (SELECT x.attr, x.option_value AS a, y.option_value AS b FROM schema_options x JOIN schema_options y USING (attr)), c AS (SELECT attr, a, b, count(*) AS n FROM pairs GROUP BY ALL)
SELECT attr, a, b, round((coalesce(n, 0) + 0.1::DOUBLE) / sum(coalesce(n, 0) + 0.1::DOUBLE) OVER (PARTITION BY attr, a), 9) AS p FROM g LEFT JOIN c USING (attr, a, b)""")
def confusion_smoothed(spark, sf_dir):
    """Smoothed confusion of carried and annotated labels over all pairs of options."""
    classes = data.table(spark, sf_dir, "schema_options").select("attr", F.col("option_value").alias("value"))
    return confusion(_pairs(spark, sf_dir), classes, ["attr"]).withColumn("p", F.round("p", 9))


@query(data.ctes(*_PAIRS) + """, t AS (SELECT attr, a AS v, count(*) AS t, count(*) FILTER (a = b) AS tp FROM pairs GROUP BY ALL), q AS (SELECT attr, b AS v, count(*) AS q FROM pairs GROUP BY ALL)
SELECT attr, round(sum(tp)::DOUBLE / sum(t), 6) AS accuracy, round(avg(2.0::DOUBLE * tp / (t + coalesce(q, 0))), 6) AS macro_f1 FROM t LEFT JOIN q USING (attr, v) GROUP BY attr""")
def macro_f1_carried(spark, sf_dir):
    """Accuracy and macro-F1 of annotated against carried labels."""
    return _rounded(macro_f1(_pairs(spark, sf_dir), ["attr"]))


_MEANS = "round(avg(jsd), 6) AS jsd_mean, round(avg(jsd) FILTER (attr IN ('sample_size', 'dominant_data_type')), 6) AS jsd_blind_mean, round(avg(jsd) FILTER (attr NOT IN ('sample_size', 'dominant_data_type', 'research_goal')), 6) AS jsd_other_mean"


@query(data.ctes(*_BOTH) + f"SELECT {_MEANS} FROM {jsd_sql('qlong', 'plong')}")
def metric_means_pool(spark, sf_dir):
    """Mean distances over all, blind and other attributes."""
    j = jensen_shannon(data.pool_long(spark, sf_dir), data.private_long(spark, sf_dir), ["attr"])
    return _rounded(metric_means(j, ["sample_size", "dominant_data_type"], ["research_goal"]))


@query()
def nnls_corrected(spark, sf_dir):
    """Confusion-corrected marginals of the annotated labels: least squares over a small matrix per attribute, so without SQL."""
    options = data.table(spark, sf_dir, "schema_options").select("attr", F.col("option_value").alias("value"))
    return corrected(_pairs(spark, sf_dir), options)
