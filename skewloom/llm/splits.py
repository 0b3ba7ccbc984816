"""Splits that keep related records together.

Relations become edges, edges become components by hash-to-min rounds, and weighted rendezvous
hashing sends each component to a split, so adding or dropping a split moves as few components as
possible and no state is kept between runs.
"""

from __future__ import annotations

import operator
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import forget, written
from .common import plain, uniform, with_group_min


def group_edges(df: DataFrame, id_col: str, columns: list[str], compare=plain) -> DataFrame:
    """Edges (a, b) from each record to the smallest id among those that agree in all ``columns``.

    A star per group instead of all pairs. Rows with a null in any of the columns relate to none;
    string columns are compared by ``compare``. A 16-byte digest stands for the compared values, each
    written with its length, so that values which contain the separator stay apart.
    """
    kinds = dict(df.dtypes)
    parts = [compare(F.col(c)) if kinds[c] == "string" else F.col(c).cast("string") for c in columns]
    whole = F.concat_ws("\x1f", *(x for p in parts for x in (F.length(p).cast("string"), p)))
    present = reduce(operator.and_, (F.col(c).isNotNull() for c in [id_col, *columns]))
    keyed = df.where(present).select(F.col(id_col).alias("a"), F.unhex(F.md5(whole)).alias("_k")).distinct()
    return with_group_min(keyed, ["_k"], "a", "b", least=2).select("a", "b").where("a <> b")


def reference_edges(df: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """Edges (a, b) from each record to the existing record that it names in ``parent_col``."""
    links = df.select(F.col(id_col).alias("a"), F.col(parent_col).alias("b")).dropna().where("a <> b").distinct()
    return links.join(df.select(F.col(id_col).alias("b")).distinct(), "b", "left_semi").select("a", "b")


def components(edges: DataFrame, max_rounds: int = 60, hot_rows: int = 100_000) -> DataFrame:
    """(node, component) of every node that has an edge; the component is its smallest node.

    Hash-to-min: node v holds a cluster C(v), kept as rows (v, u) and never as one array. In each
    round v sends C(v) to m = min C(v), and m to every member of C(v); what a node receives is its
    next cluster. Once stable, the smallest node of a component holds all of it and the others hold
    that node alone. Rounds grow with the logarithm of the longest path. Each round is a written
    table. Null ends and loops are left out; an empty table gives an empty result. Not stable after
    ``max_rounds``: RuntimeError.
    """
    edges = edges.select("a", "b").dropna().where("a <> b")
    both = edges.union(edges.select("b", "a")).toDF("v", "u")
    now = written(both.union(both.select("v", "v")).distinct())
    mark = _fingerprint(now)
    for _ in range(max_rounds):
        sent = with_group_min(now, ["v"], "u", "m", hot_rows=hot_rows if mark[0] > hot_rows else None).select(
            F.inline(F.array(F.struct(F.col("m").alias("v"), F.col("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u"))))
        )
        new = written(sent.distinct())
        before, mark = mark, _fingerprint(new)
        forget(now)
        now = new
        if mark == before:
            return now.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
    raise RuntimeError(f"not stable after {max_rounds} rounds")


def _fingerprint(table: DataFrame) -> tuple:
    """Number of rows and a sum of row hashes: equal for equal sets of rows."""
    one = F.xxhash64("v", "u").cast("decimal(38,0)")
    return tuple(table.agg(F.count(F.lit(1)), F.sum(one)).first())


def rendezvous(key: str, weights: Mapping[str, float], seed: int = 0):
    """The split with the least -ln(u) / weight, with u drawn per key and split; nulls are a key too."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    drawn = [
        F.struct((-F.log(uniform(F.lit(seed), F.lit(s), F.col(key))) / F.lit(float(w))).alias("d"), F.lit(s).alias("s"))
        for s, w in weights.items()
    ]
    return (F.least(*drawn) if len(drawn) > 1 else drawn[0])["s"]


def grouped_split(df: DataFrame, id_col: str, edges: DataFrame, weights: Mapping[str, float], seed: int = 0) -> DataFrame:
    """(id, family, split) once per distinct id; ids without an edge are families of their own.

    Null ids drop out. Proportions hold for families; one family of a large share shifts them, which
    the counts per split show.
    """
    ids = df.select(id_col).dropna().distinct()
    found = components(edges).withColumnRenamed("node", id_col)
    whole = ids.join(found, id_col, "left").withColumn("family", F.coalesce("component", id_col))
    return whole.select(id_col, "family").withColumn("split", rendezvous("family", weights, seed))
