"""Whole analyses made of the operators: visibility, correction by votes, evaluation of annotators, drift."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import bound
from ..functions.hashrng import normal, uniform
from ..storage import written
from .agreement import chance_agreement, cohen_kappa, confusion, corrected_marginal, jensen_shannon, macro_f1
from .report import correction_table
from .selection import top_k


def group_kappa(neighbours: DataFrame, labels: DataFrame, members: DataFrame, by: Sequence[str] = ("attr",)) -> DataFrame:
    """(by, kappa) of neighbours that were looked for inside groups only.

    ``members`` has (id, group, is_query) of every query and reference, ``labels`` (id, by, value). Agreement is the mean over
    queries of the share of their neighbours with the same label; chance that of the group's pooled labels; both weigh groups by
    their queries, and groups without a reference do not count. Null where chance is 1.
    """
    q = labels.select(F.col("id").alias("query_id"), *by, F.col("value").alias("_q"))
    r = labels.select(F.col("id").alias("ref_id"), *by, F.col("value").alias("_r"))
    each = neighbours.join(q, "query_id").join(r, ["ref_id", *by]).groupBy(*by, "query_id").agg(F.avg((F.col("_q") == F.col("_r")).cast("double")).alias("_a"))
    agree = each.groupBy(*by).agg(F.avg("_a").alias("_a"))
    sides = members.groupBy("group").agg(F.sum(F.col("is_query").cast("bigint")).alias("_n"), F.min("is_query").alias("_only"))
    sides = sides.where(~F.col("_only")).select("group", "_n")
    pooled = labels.join(members.select("id", "group"), "id")
    chance = chance_agreement(pooled, [*by, "group"]).join(sides, "group").groupBy(*by).agg((F.sum(F.col("_n") * F.col("chance")) / F.sum("_n")).alias("_c"))
    out = agree.join(chance, list(by))
    return out.select(*by, F.when(F.col("_c") < 1, (F.col("_a") - F.col("_c")) / (1 - F.col("_c"))).alias("kappa"))


def blind_table(per_repeat: DataFrame, value: str = "kappa") -> DataFrame:
    """(attr, knn_kappa, sd, place): mean and deviation over repeats; place 1 is the attribute that is seen least."""
    out = per_repeat.groupBy("attr").agg(F.avg(value).alias("knn_kappa"), F.stddev_samp(value).alias("sd"))
    return out.withColumn("place", F.row_number().over(Window.orderBy("knn_kappa", "attr")))  # a row per attribute


def twin_rate(neighbours: DataFrame, groups: DataFrame) -> DataFrame:
    """(twin_rate): share of the nearest neighbours that are of the query's own group; ``groups`` has (id, group)."""
    q, r = groups.toDF("query_id", "_a"), groups.toDF("ref_id", "_b")
    pairs = neighbours.where("rank = 1").join(q, "query_id").join(r, "ref_id")
    return pairs.agg(F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("twin_rate"))


def vote_concentration(votes: DataFrame, k: int) -> DataFrame:
    """(with_votes, most, top_share): candidates with votes, the most votes, the share that the k best hold."""
    some = votes.where("votes > 0")
    top = top_k(some, k, score="votes").agg(F.sum("votes").alias("_t"))
    every = some.agg(F.count(F.lit(1)).alias("with_votes"), F.max("votes").alias("most"), F.sum("votes").alias("_s"))
    return every.join(F.broadcast(top)).select("with_votes", "most", F.try_divide("_t", "_s").alias("top_share"))  # one row each


def two_stage(long: DataFrame, by: Sequence[str], repeat: str = "repeat", value: str = "value") -> DataFrame:
    """(by, mean, sd, n): means over attributes per repeat, then their mean and sample deviation over the repeats."""
    first = long.where(F.col(value).isNotNull()).groupBy(*by, repeat).agg(F.avg(value).alias("_v"))
    agg = (F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("sd"), F.count(F.lit(1)).alias("n"))
    return first.groupBy(*by).agg(*agg) if by else first.agg(*agg)


def selections(candidates: DataFrame, k: int, repeats: int, sigmas: Sequence[float], seed: int = 0) -> DataFrame:
    """(kind, rep, id): K ids at random, ``repeats`` times, and the K of the most votes, for every noise in ``sigmas``.

    ``candidates`` has (id, votes). The kinds are 'random' and 'vote<sigma>'; a vote without noise is one selection. All of
    them are one plan.
    """
    runs = [("random", r, None) for r in range(repeats)]
    runs += [(f"vote{s:g}", r, float(s)) for s in sigmas for r in range(repeats if s else 1)]
    own = F.explode(F.array(*(F.struct(F.lit(a).alias("kind"), F.lit(r).alias("rep"), F.lit(s).cast("double").alias("sigma")) for a, r, s in runs)))
    every = candidates.withColumn("_r", own).select("id", "votes", "_r.*")
    key = F.concat_ws("/", F.col("kind"), F.col("rep").cast("string"), F.col("id").cast("string"))
    noise = F.when(F.col("sigma") > 0, F.col("sigma") * normal(seed, "select", key)).otherwise(0.0)
    score = F.when(F.col("sigma").isNull(), uniform(seed, "random", key)).otherwise(F.round(F.col("votes") + noise, 9))
    return top_k(every.withColumn("score", score), k, ["kind", "rep"], ident="id").select("kind", "rep", "id")


def vote_correction(candidates: DataFrame, labels: DataFrame, target: DataFrame, k: int, repeats: int = 10, sigmas: Sequence[float] = (0.0,), seed: int = 0) -> DataFrame:
    """(sigma, attr, pool, random, random_sd, floor, vote, correction): how much of a random selection's distance the vote removes.

    ``candidates`` has (id, votes); ``labels`` (id, attr, value) of the candidates and ``target`` of the target set. 'pool' is
    the distance of all candidates, 'floor' that of K target rows drawn at random. A correction is null where random and
    floor differ by no more than two (population) deviations of random.
    """
    chosen = selections(candidates, k, repeats, sigmas, seed).join(labels, "id").select("kind", "rep", "attr", "value")
    ids = target.select("id").distinct().withColumn("votes", F.lit(0))
    floor = selections(ids, k, repeats, [], seed + 1).withColumn("kind", F.lit("floor")).join(target, "id").select("kind", "rep", "attr", "value")
    pool = labels.select(F.lit("pool").alias("kind"), F.lit(0).alias("rep"), "attr", "value")
    every = chosen.unionByName(floor).unionByName(pool).withColumn("_w", F.lit(1.0))
    runs = [("pool", 0), *((c, r) for c in ("random", "floor") for r in range(repeats)), *((f"vote{s:g}", r) for s in sigmas for r in range(repeats if s else 1))]
    known = F.broadcast(labels.sparkSession.createDataFrame(runs, "kind string, rep int"))  # a row per selection
    goal = target.where("value is not null").groupBy("attr", "value").agg(F.count(F.lit(1)).cast("double").alias("_w")).crossJoin(known)
    jsd = jensen_shannon(every, goal, ["kind", "rep", "attr"], weight="_w")
    # One table per noise: its vote beside the selections that all share.
    names = F.array(*(F.struct(F.lit(float(s)).alias("sigma"), F.lit(f"vote{s:g}").alias("_k")) for s in sigmas))
    split = jsd.select("attr", "kind", "jsd", F.inline(names)).where("kind in ('pool', 'random', 'floor') or kind = _k")
    split = split.withColumn("kind", F.when(F.col("kind").startswith("vote"), "vote").otherwise(F.col("kind")))
    return correction_table(split, ["sigma"])


def drawn_value(u: Column, steps: Column) -> Column:
    """The value of a draw ``u`` from a distribution given as an array of (cumulative share, value) in ascending order.

    The draw itself is one element of a one-element array, so that its hash is taken once and not for every step.
    """
    at = bound(u, lambda x: F.size(F.filter(steps["c"], lambda c: c <= x)))
    return F.get(steps["value"], F.least(at, F.size(steps) - 1))


def distribution_steps(counts: DataFrame, by: Sequence[str], value: str = "value", count: str = "n") -> DataFrame:
    """(by, steps): each distribution as an array of (cumulative share, value) by value; a row per distribution."""
    own = Window.partitionBy(*by)
    upto = F.sum(count).over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) / F.sum(count).over(own)
    each = counts.withColumn("c", F.round(upto, 12))
    return each.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("c", F.col(value).alias("value")))).alias("steps"))


def resampled_floor(labels: DataFrame, draws: int = 20, seed: int = 0) -> DataFrame:
    """(attr, floor): mean distance of ``draws`` resamples, each as large as the labels, to the labels (id, attr, value) themselves.

    A resample draws every label from the labels' distribution, so nothing but counts is moved.
    """
    some = labels.where("value is not null")
    counts = written(some.groupBy("attr", "value").agg(F.count(F.lit(1)).alias("n")))
    steps = F.broadcast(distribution_steps(counts, ["attr"]))  # a row per attribute, as long as its vocabulary
    rep = F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))
    each = some.select("id", "attr").join(steps, "attr").withColumn("rep", rep)
    u = uniform(seed, "floor", F.concat_ws("/", F.col("rep").cast("string"), F.col("attr"), F.col("id").cast("string")))
    again = each.groupBy("attr", "rep", drawn_value(u, F.col("steps")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    goal = counts.withColumn("rep", rep)
    return jensen_shannon(again, goal, ["attr", "rep"], weight="n").groupBy("attr").agg(F.avg("jsd").alias("floor"))


def evaluate(pairs: DataFrame, classes: DataFrame, draws: int = 20, seed: int = 0, smooth: float = 0.1) -> DataFrame:
    """(attr, n, kappa, macro_f1, accuracy, marginal_jsd, marginal_jsd_corrected, marginal_jsd_floor) of an annotator.

    ``pairs`` has (id, attr, a, b): true and predicted labels; ``classes`` (attr, value) the vocabularies. Rows without a true
    label do not count. The correction solves for the distribution that the (smoothed) confusion turns into the predicted
    one; the floor is the distance of resampled true labels.
    """
    known = written(pairs.where("a is not null").select("id", "attr", "a", "b"))  # read by every measure
    quality = cohen_kappa(known, ["attr"]).select("attr", "n", "kappa").join(macro_f1(known, ["attr"]), "attr")
    true, pred = (known.select("id", "attr", F.col(c).alias("value")) for c in "ab")
    raw = jensen_shannon(pred, true, ["attr"]).withColumnRenamed("jsd", "marginal_jsd")
    fixed = corrected(known, classes, smooth)
    share = lambda d: d.where("value is not null").groupBy("attr", "value").agg(F.count(F.lit(1)).cast("double").alias("w"))
    mended = jensen_shannon(fixed.withColumnRenamed("p", "w"), share(true), ["attr"], weight="w").withColumnRenamed("jsd", "marginal_jsd_corrected")
    floor = resampled_floor(true, draws, seed).withColumnRenamed("floor", "marginal_jsd_floor")
    out = quality.join(raw, "attr", "left").join(mended, "attr", "left").join(floor, "attr", "left")
    return out.select("attr", "n", "kappa", "macro_f1", "accuracy", "marginal_jsd", "marginal_jsd_corrected", "marginal_jsd_floor")


def corrected(pairs: DataFrame, classes: DataFrame, smooth: float = 0.1) -> DataFrame:
    """(attr, value, p): confusion-corrected marginals of predicted labels, by least squares over each attribute's small matrix."""
    rows = confusion(pairs, classes, ["attr"], smooth)
    predicted = pairs.where("b is not null").groupBy("attr", "b").agg(F.count(F.lit(1)).cast("double").alias("share"))

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        names = sorted(part["a"].unique())
        matrix = part.pivot(index="a", columns="b", values="p").loc[names, names].to_numpy()
        share = part.drop_duplicates("b").set_index("b")["share"].reindex(names).fillna(0.0).to_numpy()
        p = corrected_marginal(matrix, share / max(share.sum(), 1e-12))
        return pd.DataFrame({"attr": part["attr"].iloc[0], "value": names, "p": np.asarray(p, dtype=float)})

    return rows.join(predicted, ["attr", "b"], "left").groupBy("attr").applyInPandas(solve, "attr string, value string, p double")


def drift_summary(long: DataFrame, by: Sequence[str], run: Sequence[str], last: int, first: int = 0, value: str = "value") -> DataFrame:
    """(by, first, last, change, se, n): means of both rounds, and the mean paired change with its standard error.

    Runs that lack one of the rounds drop out; the error is null for one run.
    """
    at = lambda r: F.max(F.when(F.col("round") == r, F.col(value)))
    pairs = long.groupBy(*by, *run).agg(at(first).alias("_a"), at(last).alias("_b")).where("_a is not null and _b is not null")
    d = F.col("_b") - F.col("_a")
    return pairs.groupBy(*by).agg(
        F.avg("_a").alias("first"), F.avg("_b").alias("last"), F.avg(d).alias("change"),
        (F.stddev_samp(d) / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("se"), F.count(F.lit(1)).alias("n"),
    )


def length_null(rows: DataFrame, real: DataFrame, by: Sequence[str], draws: int = 10, seed: int = 0) -> DataFrame:
    """(by, attr, jsd, null, excess): distance to the real texts, and what lengths alone would make of it.

    Both frames have (id, length_bin, attr, bin) with a row per attribute, ``rows`` also the ``by`` columns. The null draws
    for every row a real text of the nearest length bin that has any (the smaller on ties), ``draws`` times; as only
    histograms count, it draws the attribute's bin from the real bins at that length.
    """
    counts = written(real.groupBy("attr", "length_bin", "bin").agg(F.count(F.lit(1)).alias("n")))
    rows = written(rows.select("id", *by, "length_bin", "attr", "bin"))
    have = counts.groupBy("attr").agg(F.sort_array(F.collect_set("length_bin")).alias("_have"))
    steps = distribution_steps(counts, ["attr", "length_bin"], "bin").withColumnRenamed("length_bin", "_near")
    goal = counts.groupBy("attr", "bin").agg(F.sum("n").alias("n"))
    near = F.array_min(F.transform("_have", lambda b: F.struct(F.abs(b - F.col("length_bin")).alias("d"), b.alias("b"))))["b"]
    # A row per attribute, and one per attribute and length bin.
    placed = rows.join(F.broadcast(have), "attr").withColumn("_near", near).join(F.broadcast(steps), ["attr", "_near"])
    placed = placed.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = uniform(seed, "length", F.concat_ws("/", F.col("rep").cast("string"), F.col("attr"), F.col("id").cast("string")))
    again = placed.groupBy(*by, "attr", "rep", drawn_value(u, F.col("steps")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    seen = rows.groupBy(*by, "attr", "bin").agg(F.count(F.lit(1)).alias("n"))
    runs = seen.select(*by, "attr").distinct()
    observed = jensen_shannon(seen, runs.join(goal, "attr"), [*by, "attr"], value="bin", weight="n")
    reps = runs.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    null = jensen_shannon(again, reps.join(goal, "attr"), [*by, "attr", "rep"], value="bin", weight="n").groupBy(*by, "attr").agg(F.avg("jsd").alias("null"))
    return observed.join(null, [*by, "attr"]).withColumn("excess", F.col("jsd") - F.col("null"))
