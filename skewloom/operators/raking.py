"""Raked selection: quotas of joint cells that meet the targets of several attributes at once.

The cells of a run are a small table (the product of a few vocabularies); fitting them is sequential by
nature and is one task per run, everything about rows stays distributed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .selection import _with_k, largest_remainder, select_by_quota, top_k


def rake(
    base: np.ndarray, pool: np.ndarray, members: Mapping[str, np.ndarray], targets: Mapping[str, Mapping[str, float]],
    strength: float, caps: np.ndarray, smoothing: float = 0.05, sweeps: int = 300, tolerance: float = 1e-6,
) -> np.ndarray:
    """Cell weights by iterative proportional fitting with caps.

    ``members[a][i]`` is the value of attribute a in cell i. The start mixes the base shares with the
    pool's; the goal of each value is target^strength * base^(1 - strength). A cell above its cap is
    set to it and stays there, and the goals of its values are met by the other cells.
    """
    w = base + smoothing * pool
    w = w / w.sum()
    fixed = np.zeros(len(w), dtype=bool)
    goals = {}
    for a, value in members.items():
        names, at = np.unique(value, return_inverse=True)
        every = sorted({*names, *targets[a]})
        have = dict(zip(names, np.bincount(at, base)))
        goal = np.array([targets[a].get(v, 0.0) ** strength * have.get(v, 0.0) ** (1 - strength) for v in every])
        if goal.sum() <= 0:
            goal = np.array([have.get(v, 0.0) for v in every])
        share = dict(zip(every, goal / goal.sum()))
        goals[a] = (at, np.array([share[v] for v in names]))
    for _ in range(sweeps):
        change = 0.0
        for at, goal in goals.values():
            now = np.bincount(at, w, len(goal))
            change = max(change, np.abs(now - goal).max())
            held = np.bincount(at, np.where(fixed, w, 0.0), len(goal))
            free = now - held
            factor = np.divide(np.maximum(goal - held, 0.0), free, out=np.zeros_like(free), where=free > 1e-15)
            w = np.where(fixed, w, w * factor[at])
            over = ~fixed & (w > caps)
            w[over] = caps[over]
            fixed |= over
        if change < tolerance:
            break
    return w


def raked_quotas(
    candidates: DataFrame, targets: DataFrame, attributes: Sequence[str], strength: float, k: int | DataFrame,
    run: Sequence[str] = (), own: DataFrame | None = None, score: str = "score",
) -> DataFrame:
    """(run, attributes..., quota): whole quotas of the joint cells that a run's candidates have, never above what a cell holds.

    ``targets`` has (attr, value, p); ``own`` (run, attr, value, p) replaces them for the runs that it has. ``k`` may be a
    table (run, k). A run's cells are one task; runs, such as classes, are fitted side by side.
    """
    if not run:
        one = lambda d: d if d is None or not isinstance(d, DataFrame) else d.withColumn("_run", F.lit(0))
        return raked_quotas(one(candidates), targets, attributes, strength, one(k), ["_run"], one(own), score).drop("_run")
    base = top_k(candidates, k, run, score).groupBy(*run, *attributes).agg(F.count(F.lit(1)).alias("r"))
    counts = candidates.groupBy(*run, *attributes).agg(F.count(F.lit(1)).alias("have")).join(base, [*run, *attributes], "left").fillna(0, ["r"])
    cells = _with_k(counts, k, run)
    named = targets.where(F.col("attr").isin(list(attributes))).select("attr", "value", "p")
    every = cells.select(*run).distinct()
    if own is None:
        goals = every.crossJoin(F.broadcast(named))  # a row per value of the vocabularies
    else:
        own = own.where(F.col("attr").isin(list(attributes))).select(*run, "attr", "value", "p")
        goals = own.unionByName(every.join(own.select(*run).distinct(), list(run), "left_anti").crossJoin(F.broadcast(named)))

    goals = goals.select(*(F.col(c).alias(c) for c in (*run, "attr", "value", "p")))  # columns of its own, for the cogroup

    def fit(cell: pd.DataFrame, goal: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(list(attributes), ignore_index=True)
        wanted: dict[str, dict[str, float]] = {a: {} for a in attributes}
        for a, v, p in zip(goal["attr"], goal["value"], goal["p"]):
            wanted[a][v] = p
        if not len(cell):
            return cell.assign(w=0.0)
        have = cell["have"].to_numpy(dtype=float)
        members = {a: cell[a].to_numpy(dtype=str) for a in attributes}
        return cell.assign(w=rake(cell["r"].to_numpy() / max(cell["r"].sum(), 1), have / have.sum(), members, wanted, strength, have / cell["_k"].to_numpy()))

    fitted = cells.groupBy(*run).cogroup(goals.groupBy(*run)).applyInPandas(fit, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema), "w double"]))
    quota = largest_remainder(fitted.withColumn("_cell", F.concat_ws("\x1f", *attributes)), F.col("_k"), run, "_cell")
    return quota.select(*run, *attributes, F.least("quota", "have").alias("quota"))


def raked_select(
    candidates: DataFrame, targets: DataFrame, attributes: Sequence[str], strength: float, k: int | DataFrame,
    run: Sequence[str] = (), own: DataFrame | None = None, score: str = "score",
) -> DataFrame:
    """min(k, n) rows of every run whose marginal shares follow the targets; strength 0 is plain top-K.

    ``own`` and ``k`` as in ``raked_quotas``; columns as ``select_by_quota`` gives them.
    """
    if strength <= 0:
        return top_k(candidates, k, run, score).drop("rank").withColumn("by_quota", F.lit(True)).withColumn("in_base", F.lit(True))
    quotas = raked_quotas(candidates, targets, attributes, strength, k, run, own, score).withColumn("cell", F.struct(*attributes)).select(*run, "cell", "quota")
    return select_by_quota(candidates.withColumn("cell", F.struct(*attributes)), quotas, k, run, score=score).drop("cell")


def marginals(labels: DataFrame, attributes: Sequence[str], run: Sequence[str] = ()) -> DataFrame:
    """(run, attr, value, p): shares of each attribute's values; nulls do not count."""
    pairs = F.array(*(F.struct(F.lit(a).alias("attr"), F.col(a).alias("value")) for a in attributes))
    counts = labels.select(*run, F.inline(pairs)).where("value is not null").groupBy(*run, "attr", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*run, "attr"))).drop("n")
