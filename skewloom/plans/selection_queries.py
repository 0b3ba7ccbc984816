"""Queries of the selection family."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashrng import normal, normal_sql, uniform, uniform_sql
from ..functions.labels import clean_labels
from ..operators.knn import vote_histogram
from ..operators.raking import marginals, raked_select
from ..operators.selection import (
    cell_quotas, keep_cells, largest_remainder, quota_select, selection_info, survivors_per_class, top_k,
)
from . import data
from .catalog import query

CELLS = ["sample_size", "dominant_data_type"]
#: The pool holds every survivor and its variations: a seventh survives.
POOL_PER_SURVIVOR = 7

# Candidates: pool rows with clean labels, a score with many ties, and the joint cell of two attributes.

CAND_SQL = [
    *data.PRIVATE_LONG_SQL, *data.POOL_LONG_SQL,
    f"""cand AS (SELECT row_id AS cand_id, floor({uniform_sql(1, 'score', 'row_id')} * 10) AS score, row_id % 3 AS class,
    max(value) FILTER (attr = 'sample_size') || '|' || max(value) FILTER (attr = 'dominant_data_type') AS cell,
    max(value) FILTER (attr = 'sample_size') AS sample_size FROM qlong GROUP BY row_id)""",
    """goal AS (SELECT cell, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM (SELECT row_id, max(value) FILTER (attr = 'sample_size') || '|' ||
    max(value) FILTER (attr = 'dominant_data_type') AS cell FROM plong GROUP BY row_id) GROUP BY cell)""",
    "kk AS (SELECT count(*) // 7 AS k FROM cand)",
]


def candidates(spark, sf_dir) -> tuple[DataFrame, DataFrame, int]:
    """Candidates, target shares of the cells, and K."""
    vocabulary = data.vocabulary(spark, sf_dir)
    cell = F.concat_ws("|", *CELLS)
    rows = clean_labels(data.pool(spark, sf_dir, *CELLS), vocabulary, CELLS)
    score = F.floor(uniform(1, "score", F.col("row_id")) * 10).cast("double")
    cand = rows.select(F.col("row_id").alias("cand_id"), score.alias("score"), (F.col("row_id") % 3).alias("class"), cell.alias("cell"), *CELLS)
    own = clean_labels(data.private(spark, sf_dir, *CELLS), vocabulary, CELLS).select(cell.alias("cell"))
    goal = own.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy())).drop("n")
    return cand, goal, cand.count() // POOL_PER_SURVIVOR


def quota_sql(strength: str, cand: str = "cand", goal: str = "goal") -> list[str]:
    """Ranks, base shares, quotas, cells' best and water-filling, for one run."""
    return [
        f"ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, cand_id) AS rank FROM {cand})",
        "base AS (SELECT cell, count(*)::DOUBLE / sum(count(*)) OVER () AS r FROM ranked, kk WHERE rank <= k GROUP BY cell)",
        f"w AS (SELECT cell, coalesce(p, 0) AS p, coalesce(r, 0) AS r, pow(coalesce(p, 0)::DOUBLE, {strength}) * pow(coalesce(r, 0)::DOUBLE, 1 - {strength}) AS w FROM base FULL JOIN {goal} USING (cell))",
        "sh AS (SELECT cell, p, r, round(CASE WHEN sum(w) OVER () > 0 THEN k * w / sum(w) OVER () ELSE 0 END, 9) AS s FROM w, kk)",
        "quotas AS (SELECT cell, p, r, floor(s) + CASE WHEN row_number() OVER (ORDER BY round(s - floor(s), 9) DESC, cell) <= round(sum(s) OVER ()) - sum(floor(s)) OVER () THEN 1 ELSE 0 END AS quota FROM sh)",
        """chosen AS (SELECT cand_id, score, cell, by_quota, rank <= k AS in_base FROM (SELECT *, row_number() OVER (ORDER BY by_quota DESC, rank) AS o FROM
        (SELECT x.*, coalesce(c <= quota, false) AS by_quota FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY rank) AS c FROM ranked) x LEFT JOIN quotas USING (cell))), kk WHERE o <= k)""",
    ]


FLAGSHIP_SQL = [
    data.VECTORS_SQL,
    data.nearest_sql("nn", 1),
    """cand AS (SELECT c.id AS cand_id, coalesce(n, 0)::DOUBLE AS score, (c.label % 5)::VARCHAR || '|' || (c.label % 2)::VARCHAR AS cell FROM cands c
    LEFT JOIN (SELECT ref_id AS id, count(*) AS n FROM nn GROUP BY 1) USING (id))""",
    "goal AS (SELECT (label % 5)::VARCHAR || '|' || (label % 2)::VARCHAR AS cell, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM voters GROUP BY 1)",
    "kk AS (SELECT count(*) // 4 AS k FROM cand)",
]


@query(data.ctes(*FLAGSHIP_SQL, *quota_sql("0.5")) + "SELECT cand_id, score, cell, by_quota, in_base FROM chosen")
def quota_topk_by_cell(spark, sf_dir):
    """Nearest-neighbour votes, top-K, quotas of joint cells at strength 0.5, best of each cell, water-filling."""
    voters, cands = data.voters_and_candidates(spark, sf_dir)
    cell = F.concat_ws("|", (F.col("label") % 5).cast("string"), (F.col("label") % 2).cast("string"))
    votes = vote_histogram(voters, cands).withColumn("score", F.col("votes").cast("double"))
    cand = votes.join(cands.select(F.col("id").alias("cand_id"), cell.alias("cell")), "cand_id").select("cand_id", "score", "cell")
    goal = voters.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy())).drop("n")
    return quota_select(cand, goal, 0.5, cands.count() // 4).select("cand_id", "score", "cell", "by_quota", "in_base")


@query(data.ctes(*CAND_SQL) + "SELECT cand_id, score, rank FROM (SELECT cand_id, score, row_number() OVER (ORDER BY score DESC, cand_id) AS rank FROM cand), kk WHERE rank <= k")
def topk_rank_ties(spark, sf_dir):
    """The K best candidates with their rank; tied scores go to the smaller id."""
    cand, _, k = candidates(spark, sf_dir)
    return top_k(cand.select("cand_id", "score"), k)


@query(data.ctes(*CAND_SQL) + f"SELECT cand_id, score, rank FROM (SELECT cand_id, score, row_number() OVER (ORDER BY score DESC, cand_id) AS rank FROM (SELECT cand_id, round(score + 2.5788 * {normal_sql(0, 'vote0', 'cand_id')}, 6) AS score FROM cand)), kk WHERE rank <= k")
def noisy_topk(spark, sf_dir):
    """Top-K of scores with Gaussian noise of the published deviation at epsilon 4."""
    cand, _, k = candidates(spark, sf_dir)
    noisy = F.round(F.col("score") + 2.5788 * normal(0, "vote0", F.col("cand_id")), 6)
    return top_k(cand.select("cand_id", noisy.alias("score")), k)


@query(data.ctes(*CAND_SQL, *quota_sql("1.0")) + "SELECT cell, quota::BIGINT AS quota FROM quotas")
def largest_remainder_cells(spark, sf_dir):
    """Whole quotas of K over the target's cells."""
    cand, goal, k = candidates(spark, sf_dir)
    every = cand.select("cell").distinct().join(goal, "cell", "full_outer").fillna(0.0, ["p"])
    base = top_k(cand, k).select("cell").distinct()
    every = every.join(base.withColumn("_b", F.lit(1)), "cell", "left").where("_b = 1 or p > 0").drop("_b")
    return largest_remainder(every.withColumnRenamed("p", "w"), k, [], "cell").select("cell", "quota")


@query(data.ctes(*CAND_SQL, *quota_sql("0.5")) + "SELECT cell, quota::BIGINT AS quota, round(p, 9) AS p, round(r, 9) AS r FROM quotas")
def quota_weights(spark, sf_dir):
    """Quotas from weights P^0.5 R^0.5."""
    cand, goal, k = candidates(spark, sf_dir)
    base = top_k(cand, k).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.col("n") / F.sum("n").over(Window.partitionBy())).drop("n")
    q = cell_quotas(base, goal, 0.5, k, [])
    return q.select("cell", "quota", F.round("p", 9).alias("p"), F.round("r", 9).alias("r"))


@query(data.ctes(*CAND_SQL, *quota_sql("0.75")) + "SELECT cand_id, score, cell, by_quota, in_base FROM chosen")
def quota_select_pool(spark, sf_dir):
    """Quota selection of the whole pool at strength 0.75."""
    cand, goal, k = candidates(spark, sf_dir)
    return quota_select(cand, goal, 0.75, k).select("cand_id", "score", "cell", "by_quota", "in_base")


@query(data.ctes(*CAND_SQL, *quota_sql("1.0")) + "SELECT count(*) AS chosen, count(*) FILTER (NOT by_quota) AS shortfall, max(k) - count(*) FILTER (in_base) AS moved FROM chosen, kk")
def waterfill_shortfall(spark, sf_dir):
    """Rows, rows that only water-filling chose, and rows that plain top-K does not take."""
    cand, goal, k = candidates(spark, sf_dir)
    return selection_info(quota_select(cand, goal, 1.0, k), k)


@query(data.ctes(*CAND_SQL, *quota_sql("0.5")) + "SELECT cand_id FROM chosen WHERE NOT in_base")
def moved_vs_baseline(spark, sf_dir):
    """Survivors that plain top-K would not have chosen: a set difference."""
    cand, goal, k = candidates(spark, sf_dir)
    chosen = quota_select(cand, goal, 0.5, k).select("cand_id")
    return chosen.join(top_k(cand.select("cand_id", "score"), k).select("cand_id"), "cand_id", "left_anti")


_SWEEP = (0.0, 0.25, 0.5, 0.75, 1.0)


def _sweep_sql() -> str:
    parts = ["lams AS (SELECT unnest([0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS lam)", "ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, cand_id) AS rank FROM cand)",
        "base AS (SELECT cell, count(*)::DOUBLE / sum(count(*)) OVER () AS r FROM ranked, kk WHERE rank <= k GROUP BY cell)",
        "w AS (SELECT lam, cell, pow(coalesce(p, 0)::DOUBLE, lam) * pow(coalesce(r, 0)::DOUBLE, 1 - lam) AS w FROM (SELECT * FROM base FULL JOIN goal USING (cell)), lams)",
        "sh AS (SELECT lam, cell, round(CASE WHEN sum(w) OVER (PARTITION BY lam) > 0 THEN k * w / sum(w) OVER (PARTITION BY lam) ELSE 0 END, 9) AS s FROM w, kk)",
        "quotas AS (SELECT lam, cell, floor(s) + CASE WHEN row_number() OVER (PARTITION BY lam ORDER BY round(s - floor(s), 9) DESC, cell) <= round(sum(s) OVER (PARTITION BY lam)) - sum(floor(s)) OVER (PARTITION BY lam) THEN 1 ELSE 0 END AS quota FROM sh)",
        """chosen AS (SELECT lam, cand_id, by_quota, rank <= k AS in_base FROM (SELECT *, row_number() OVER (PARTITION BY lam ORDER BY by_quota DESC, rank) AS o FROM
        (SELECT x.*, coalesce(c <= quota, false) AS by_quota FROM (SELECT lam, ranked.*, row_number() OVER (PARTITION BY lam, cell ORDER BY rank) AS c FROM ranked, lams) x LEFT JOIN quotas USING (lam, cell))), kk WHERE o <= k)"""]  # fmt: skip
    return data.ctes(*CAND_SQL, *parts) + "SELECT lam, count(*) AS chosen, count(*) FILTER (NOT by_quota) AS shortfall, max(k) - count(*) FILTER (in_base) AS moved FROM chosen, kk GROUP BY lam"


@query(_sweep_sql())
def lambda_sweep_one_job(spark, sf_dir):
    """Every strength of a sweep in one plan; the strength is part of every key."""
    cand, goal, k = candidates(spark, sf_dir)
    lams = F.explode(F.array(*(F.lit(x) for x in _SWEEP)))
    runs, goals = cand.withColumn("lam", lams), goal.withColumn("lam", lams)
    return selection_info(quota_select(runs, goals, F.col("lam"), k, ["lam"]), k, ["lam"])


def _class_sql() -> str:
    parts = ["ks AS (SELECT class, count(*) // 7 AS kc FROM cand GROUP BY class)", "ranked AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY score DESC, cand_id) AS rank FROM cand)"]
    return data.ctes(*CAND_SQL, *parts) + "SELECT class, cand_id, rank FROM ranked JOIN ks USING (class) WHERE rank <= kc"


@query(_class_sql())
def select_per_class_kg(spark, sf_dir):
    """The best K_g candidates of every class."""
    cand, _, _ = candidates(spark, sf_dir)
    sizes = cand.groupBy("class").agg(F.floor(F.count(F.lit(1)) / POOL_PER_SURVIVOR).alias("k"))
    return top_k(cand.select("class", "cand_id", "score"), sizes, ["class"]).select("class", "cand_id", "rank")


def _quota_class_sql() -> str:
    p = "PARTITION BY class"
    parts = [f"ranked AS (SELECT *, row_number() OVER ({p} ORDER BY score DESC, cand_id) AS rank FROM cand)", "kc AS (SELECT class, count(*) // 7 AS kc FROM cand GROUP BY class)",
        f"base AS (SELECT class, cell, count(*)::DOUBLE / sum(count(*)) OVER ({p}) AS r FROM ranked JOIN kc USING (class) WHERE rank <= kc GROUP BY class, cell)",
        "w AS (SELECT class, cell, pow(coalesce(p, 0)::DOUBLE, 0.5) * pow(coalesce(r, 0)::DOUBLE, 0.5) AS w FROM base FULL JOIN (SELECT * FROM (SELECT DISTINCT class FROM cand), goal) USING (class, cell))",
        f"sh AS (SELECT class, cell, round(kc * w / sum(w) OVER ({p}), 9) AS s FROM w JOIN kc USING (class))",
        f"quotas AS (SELECT class, cell, floor(s) + CASE WHEN row_number() OVER ({p} ORDER BY round(s - floor(s), 9) DESC, cell) <= round(sum(s) OVER ({p})) - sum(floor(s)) OVER ({p}) THEN 1 ELSE 0 END AS quota FROM sh)",
        f"""chosen AS (SELECT class, cand_id, by_quota FROM (SELECT *, row_number() OVER ({p} ORDER BY by_quota DESC, rank) AS o FROM
        (SELECT x.*, coalesce(c <= quota, false) AS by_quota FROM (SELECT *, row_number() OVER (PARTITION BY class, cell ORDER BY rank) AS c FROM ranked) x LEFT JOIN quotas USING (class, cell))) JOIN kc USING (class) WHERE o <= kc)"""]  # fmt: skip
    return data.ctes(*CAND_SQL, *parts) + "SELECT class, cand_id, by_quota FROM chosen"


@query(_quota_class_sql())
def quota_per_class_kg(spark, sf_dir):
    """Quota selection inside every class at strength 0.5, each with its own K."""
    cand, goal, _ = candidates(spark, sf_dir)
    k = cand.groupBy("class").agg(F.floor(F.count(F.lit(1)) / POOL_PER_SURVIVOR).alias("k"))
    return quota_select(cand, goal, 0.5, k, ["class"]).select("class", "cand_id", "by_quota")


@query(data.ctes(*CAND_SQL) + ", c AS (SELECT sample_size AS class, count(*) AS n FROM cand GROUP BY 1), s AS (SELECT class, round(2000::DOUBLE * n / sum(n) OVER (), 9) AS s FROM c) SELECT class, (floor(s) + CASE WHEN row_number() OVER (ORDER BY round(s - floor(s), 9) DESC, class) <= round(sum(s) OVER ()) - sum(floor(s)) OVER () THEN 1 ELSE 0 END)::BIGINT AS k FROM s")
def survivors_by_size(spark, sf_dir):
    """2,000 survivors over the sizes of all candidates, in proportion."""
    cand, _, _ = candidates(spark, sf_dir)
    return survivors_per_class(cand.groupBy(F.col("sample_size").alias("class")).agg(F.count(F.lit(1)).alias("n")), 2000)


@query(data.ctes(*CAND_SQL, "rest AS (SELECT *, row_number() OVER (ORDER BY score DESC, cand_id) AS rank FROM cand)") + "SELECT cand_id, score, rank FROM rest WHERE rank <= (SELECT 6 * k FROM kk)")
def topk_six_sevenths(spark, sf_dir):
    """All candidates but the last seventh, ranked over ranges of scores, so that no task holds a large K."""
    cand, _, k = candidates(spark, sf_dir)
    sizes = spark.createDataFrame([(6 * k,)], "k bigint")
    return top_k(cand.select("cand_id", "score"), sizes)


@query(data.ctes(*CAND_SQL) + """, n AS (SELECT cell, count(*) AS n FROM cand GROUP BY cell), r AS (SELECT cell, n, row_number() OVER (ORDER BY n DESC, cell) AS r, count(*) OVER () AS m FROM n)
SELECT CASE WHEN m > 30 AND r > 29 THEN '__other__' ELSE cell END AS cell, round(sum(n)::DOUBLE / (SELECT sum(n) FROM n), 9) AS p FROM r GROUP BY 1""")
def cell_keys_other(spark, sf_dir):
    """The 29 most frequent joint cells, the rest as one."""
    cand, _, _ = candidates(spark, sf_dir)
    return keep_cells(cand, "cell", 30).select("cell", F.round("p", 9).alias("p"))


@query()
def raked_select_pool(spark, sf_dir):
    """Raked selection over two attributes at strength 1: sequential fitting of a small cell table, so without SQL."""
    cand, _, k = candidates(spark, sf_dir)
    target = clean_labels(data.private(spark, sf_dir, *CELLS), data.vocabulary(spark, sf_dir), CELLS)
    return raked_select(cand.drop("cell"), marginals(target, CELLS), CELLS, 1.0, k).select("cand_id", "score", *CELLS, "by_quota", "in_base")
