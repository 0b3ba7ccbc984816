"""Splits and samples by hash order, so that they are reproducible and need no shuffle state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashrng import uniform


#: Parts of the hash range in which rows are counted before they are ranked; a part of 10^11 rows holds 1.5 million.
PREFIXES = 65_536


def drawn(df: DataFrame, key: Column, n: int, seed: int = 0, tag: str = "sample") -> DataFrame:
    """n rows without replacement: those of the smallest hash.

    Counts per part of the hash range say which parts are taken whole; only the rows of the part that holds the n-th are ranked.
    """
    d = df.withColumn("_u", uniform(seed, tag, key)).withColumn("_p", F.floor(F.col("_u") * PREFIXES).cast("int"))
    counts = d.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    upto = counts.withColumn("_t", F.sum("_c").over(Window.orderBy("_p")))  # at most PREFIXES rows
    edge = upto.where(F.col("_t") >= n).agg(F.min(F.struct("_p", (F.col("_t") - F.col("_c")).alias("_b"))).alias("e")).first()["e"]
    if edge is None:  # fewer than n
        return d.drop("_u", "_p")
    last = d.where(F.col("_p") == edge["_p"]).orderBy("_u", key).limit(n - edge["_b"])
    return d.where(F.col("_p") < edge["_p"]).unionByName(last).drop("_u", "_p")


def half_split(df: DataFrame, ident: str, seed: int = 0) -> DataFrame:
    """Adds ``split``: the n // 2 rows of the smallest hash are 'ref', the others 'query'.

    The boundary is an exact rank; it comes from counting rows per hash prefix, so that no task sorts
    all rows.
    """
    d = df.withColumn("_u", uniform(seed, "half", F.col(ident))).withColumn("_p", F.floor(F.col("_u") * PREFIXES).cast("int"))
    before = d.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy("_p")  # at most PREFIXES rows
    bounds = before.withColumn("_b", F.sum("_c").over(w) - F.col("_c")).withColumn("_n", F.sum("_c").over(Window.partitionBy())).drop("_c")
    inside = Window.partitionBy("_p").orderBy("_u", ident)
    rank = F.row_number().over(inside) + F.col("_b")
    return d.join(F.broadcast(bounds), "_p").withColumn("split", F.when(rank <= F.floor(F.col("_n") / 2), "ref").otherwise("query")).drop("_u", "_p", "_b", "_n")


def group_split(df: DataFrame, group: Sequence[str], parts: Sequence[tuple[str, float]], seed: int = 0, floor_rows: bool = False) -> DataFrame:
    """Adds ``split`` so that no group straddles a boundary.

    Groups in hash order take rows until their running total, itself included, passes a boundary; the
    group that crosses goes to the later part. ``parts`` are (name, share) with shares that sum to 1.
    ``floor_rows`` takes whole rows as boundaries, as a half split does.
    """
    key = F.concat_ws("\x1f", *(F.coalesce(F.col(g).cast("string"), F.lit("\x00")) for g in group))
    d = df.withColumn("_g", F.md5(key))
    sizes = d.groupBy("_g").agg(F.count(F.lit(1)).alias("_c")).withColumn("_u", uniform(seed, "group", F.col("_g")))
    sizes = sizes.withColumn("_p", F.floor(F.col("_u") * PREFIXES).cast("int"))
    prefix = sizes.groupBy("_p").agg(F.sum("_c").alias("_c"))
    over = Window.orderBy("_p")  # at most PREFIXES rows
    bounds = prefix.withColumn("_b", F.sum("_c").over(over) - F.col("_c")).withColumn("_n", F.sum("_c").over(Window.partitionBy())).drop("_c")
    running = F.sum("_c").over(Window.partitionBy("_p").orderBy("_u", "_g").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_b")
    placed = sizes.join(F.broadcast(bounds), "_p").withColumn("_t", running)
    edge, split = 0.0, None
    for name, share in parts[:-1]:
        edge += share
        inside = F.col("_t") <= (F.floor(F.col("_n") * edge) if floor_rows else F.col("_n") * edge)
        split = F.when(inside, name) if split is None else split.when(inside, name)
    split = split.otherwise(parts[-1][0]) if split is not None else F.lit(parts[0][0])
    return d.join(placed.select("_g", split.alias("split")), "_g").drop("_g")


def one_per_group(df: DataFrame, group: str, ident: str, seed: int = 0) -> DataFrame:
    """One row of each group, drawn by hash; combined before the shuffle."""
    u = uniform(seed, "one", F.col(ident))
    row = F.min(F.struct(u.alias("u"), F.col(ident).alias("i"), F.struct(*df.columns).alias("r"))).alias("m")
    return df.groupBy(group).agg(row).select("m.r.*")


def copies_and_remainder(df: DataFrame, klass: str, ident: str, wanted: DataFrame, seed: int = 0) -> DataFrame:
    """As many rows per class as ``wanted`` (class, m) says: whole copies of all its rows, and a draw for the remainder.

    Adds ``copy``, counted from 0.
    """
    sized = df.join(df.groupBy(klass).agg(F.count(F.lit(1)).alias("_n")).join(wanted, klass), klass)
    rank = F.row_number().over(Window.partitionBy(klass).orderBy(uniform(seed, "copies", F.col(ident)), ident))
    copies = F.floor(F.col("m") / F.col("_n")) + (rank <= F.col("m") % F.col("_n")).cast("bigint")
    return sized.withColumn("_k", copies).where("_k > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_k") - 1))).drop("_k", "_n", "m")


def length_matched(q: DataFrame, p: DataFrame, ident: str, bin_: str, seed: int = 0, n: int | None = None) -> DataFrame:
    """Rows of ``q`` whose bins have the shares of ``p``, as many as q's scarcest bin allows; adds ``covered``.

    ``covered`` is the share of ``p`` in bins that q has; bins of q that p lacks drop out. With ``n`` a draw of n of them.
    """
    pb = p.groupBy(bin_).agg(F.count(F.lit(1)).alias("_np")).withColumn("_share", F.col("_np") / F.sum("_np").over(Window.partitionBy()))
    qb = q.groupBy(bin_).agg(F.count(F.lit(1)).alias("_nq"))
    both = pb.join(qb, bin_)
    everywhere = Window.partitionBy()
    mass = F.sum("_share").over(everywhere)
    need = both.withColumn("covered", mass).withColumn("_w", F.col("_share") / mass)
    need = need.withColumn("_m", F.floor(F.round(F.min(F.col("_nq") / F.col("_w")).over(everywhere), 9)))
    need = need.withColumn("_k", F.least(F.bround(F.round(F.col("_m") * F.col("_w"), 9)), "_nq")).select(bin_, "covered", "_k")
    rank = F.row_number().over(Window.partitionBy(bin_).orderBy(uniform(seed, "length", F.col(ident)), ident))
    out = q.join(F.broadcast(need), bin_).withColumn("_r", rank).where("_r <= _k").drop("_r", "_k")
    return out if n is None else drawn(out, F.col(ident), n, seed, "match")
