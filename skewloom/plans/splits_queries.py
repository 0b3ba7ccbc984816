"""Queries of the split and sampling family."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.hashrng import uniform_sql
from ..functions.labels import length_bin, word_count
from ..operators.splits import copies_and_remainder, drawn, group_split, half_split, length_matched, one_per_group
from ..sources.tables import replicated
from . import data
from .catalog import query

PARTS = [("train", 0.7), ("validation", 0.15), ("test", 0.15)]


@query(f"SELECT vec_id, CASE WHEN row_number() OVER (ORDER BY {uniform_sql(0, 'half', 'vec_id')}, vec_id) <= count(*) OVER () // 2 THEN 'ref' ELSE 'query' END AS split FROM embeddings")
def half_split_vectors(spark, sf_dir):
    """Random halves of the vectors."""
    return half_split(data.table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id")


def _group_sql(key: str, source: str, ids: str, case: str) -> str:
    return f"""keyed AS (SELECT {ids}, md5({key}) AS g FROM {source}), sizes AS (SELECT g, count(*) AS c, {uniform_sql(0, 'group', 'g')} AS u FROM keyed GROUP BY g),
    run AS (SELECT g, sum(c) OVER (ORDER BY u, g) AS t, sum(c) OVER () AS n FROM sizes) SELECT {ids}, {case} AS split FROM keyed JOIN run USING (g)"""


@query("WITH " + _group_sql("page_id::VARCHAR", "documents", "doc_id", "CASE WHEN t <= n * 0.7::DOUBLE THEN 'train' WHEN t <= n * (0.7::DOUBLE + 0.15::DOUBLE) THEN 'validation' ELSE 'test' END"))
def group_701515(spark, sf_dir):
    """70/15/15 of the documents, with all revisions of a page on one side."""
    return group_split(data.table(spark, sf_dir, "documents").select("doc_id", "page_id"), ["page_id"], PARTS).select("doc_id", "split")


@query(data.ctes(data.POOL_SQL) + ", " + _group_sql("coalesce(primary_research_area, '?') || chr(31) || coalesce(disease_mention, '?')", "pool1", "row_id", "CASE WHEN t <= n // 2 THEN 'ref' ELSE 'query' END"))
def group_half_split(spark, sf_dir):
    """Halves of the pool that keep groups of two attributes together."""
    d = data.pool(spark, sf_dir, "primary_research_area", "disease_mention").fillna("?")
    return group_split(d, ["primary_research_area", "disease_mention"], [("ref", 0.5), ("query", 0.5)], floor_rows=True).select("row_id", "split")


@query(f"SELECT doc_id FROM documents ORDER BY {uniform_sql(0, 'sample', 'doc_id')}, doc_id LIMIT 200")
def sample_without_replacement(spark, sf_dir):
    """200 documents by hash, of all documents."""
    return drawn(data.table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), 200)


@query(data.ctes(data.PRIVATE_SQL) + f""", c AS (SELECT research_goal, count(*) AS n FROM private WHERE research_goal IS NOT NULL GROUP BY 1), w AS (SELECT research_goal, n, 2 * n + 3 AS m FROM c),
r AS (SELECT row_id, n, m, row_number() OVER (PARTITION BY research_goal ORDER BY {uniform_sql(0, 'copies', 'row_id')}, row_id) AS rank FROM private JOIN w USING (research_goal))
SELECT row_id, unnest(range(0, m // n + CASE WHEN rank <= m % n THEN 1 ELSE 0 END)) AS copy FROM r""")
def round0_metadata_sampling(spark, sf_dir):
    """Metadata rows for the first round: whole copies of a class and a draw for the remainder."""
    d = data.private(spark, sf_dir, "research_goal").where("research_goal is not null")
    wanted = d.groupBy("research_goal").agg((2 * F.count(F.lit(1)) + 3).alias("m"))
    return copies_and_remainder(d, "research_goal", "row_id", wanted).select("row_id", "copy")


@query(data.ctes(data.PRIVATE_SQL) + f"SELECT row_id, research_goal FROM private QUALIFY row_number() OVER (PARTITION BY research_goal ORDER BY {uniform_sql(0, 'one', 'row_id')}, row_id) = 1")
def one_per_class(spark, sf_dir):
    """One private record of each typed goal."""
    return one_per_group(data.private(spark, sf_dir, "research_goal"), "research_goal", "row_id").select("row_id", "research_goal")


_W = "(round_even(len(list_filter(regexp_split_to_array(coalesce(text, ''), '" + data.SPACE + "+'), lambda x: x <> '')) / 50.0::DOUBLE, 0) * 50)::INTEGER::VARCHAR"


@query(data.ctes(data.PRIVATE_SQL, data.POOL_SQL, f"q AS (SELECT row_id, {_W} AS bin FROM pool1)", f"p AS (SELECT {_W} AS bin FROM private)") + f""", pb AS (SELECT bin, count(*) AS np, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM p GROUP BY 1), qb AS (SELECT bin, count(*) AS nq FROM q GROUP BY 1),
b AS (SELECT bin, nq, sum(share) OVER () AS covered, share / sum(share) OVER () AS w FROM pb JOIN qb USING (bin)), m AS (SELECT *, floor(round(min(nq / w) OVER (), 9)) AS m FROM b),
k AS (SELECT bin, covered, least(round_even(round(m * w, 9), 0), nq) AS k FROM m)
SELECT row_id, bin, round(covered, 9) AS covered FROM (SELECT q.*, covered, k, row_number() OVER (PARTITION BY bin ORDER BY {uniform_sql(0, 'length', 'row_id')}, row_id) AS r FROM q JOIN k USING (bin)) WHERE r <= k""")
def length_matched_pool(spark, sf_dir):
    """Pool rows whose lengths follow those of the private texts."""
    bin_ = length_bin(word_count(F.coalesce("text", F.lit("")))).alias("bin")
    q = data.pool(spark, sf_dir, "text").select("row_id", bin_)
    p = data.private(spark, sf_dir, "text").select(bin_)
    return length_matched(q, p, "row_id", "bin").withColumn("covered", F.round("covered", 9))


@query("SELECT row_id, unnest(range(0, 6))::INTEGER AS copy FROM pool")
def replicate_and_union(spark, sf_dir):
    """Six copies of every pool row, for its variations."""
    return replicated(data.table(spark, sf_dir, "pool").select("row_id"), 6)


@query(data.ctes(data.PRIVATE_SQL) + "SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS pool_index FROM private")
def pool_index(spark, sf_dir):
    """Stable numbering from 0, by counts per id range instead of one sorted task."""
    d = data.private(spark, sf_dir, "research_goal").select("row_id").withColumn("_p", F.floor(F.col("row_id") / 1024))
    sizes = d.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = sizes.withColumn("_b", F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).drop("_c")  # a row per 1,024 ids
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("row_id")) - 1 + F.col("_b")
    return d.join(before, "_p").select("row_id", rank.alias("pool_index"))
