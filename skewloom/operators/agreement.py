"""Distances between categorical distributions and agreement between labels, as two-level aggregates.

All take long rows and group by ``by`` columns; nulls do not count.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _term(p: Column, m: Column) -> Column:
    return F.when(p > 0, p * F.log(p / m)).otherwise(0.0)


def jensen_shannon(p: DataFrame, q: DataFrame, by: Sequence[str], value: str = "value", weight: str | None = None) -> DataFrame:
    """(by, jsd): the Jensen-Shannon distance (natural logarithm) of two collections of values; null if a side is empty."""
    mass = (lambda d: F.sum(weight)) if weight else (lambda d: F.count(F.lit(1)).cast("double"))
    counts = lambda d, n: d.where(F.col(value).isNotNull()).groupBy(*by, value).agg(mass(d).alias(n))
    both = counts(p, "_p").join(counts(q, "_q"), [*by, value], "full_outer").fillna(0.0, ["_p", "_q"])
    all_ = Window.partitionBy(*by)
    both = both.withColumn("_p", F.try_divide("_p", F.sum("_p").over(all_))).withColumn("_q", F.try_divide("_q", F.sum("_q").over(all_)))
    m = (F.col("_p") + F.col("_q")) / 2
    part = (_term(F.col("_p"), m) + _term(F.col("_q"), m)) / 2
    missing = F.max((F.col("_p").isNull() | F.col("_q").isNull()).cast("int")) == 1
    jsd = F.when(~missing, F.sqrt(F.greatest(F.sum(part), F.lit(0.0))))
    return both.groupBy(*by).agg(jsd.alias("jsd")) if by else both.agg(jsd.alias("jsd"))


def chance_agreement(labels: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """(by, chance): probability that two random labels agree."""
    n = labels.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    return n.withColumn("_p", F.col("_n") / F.sum("_n").over(Window.partitionBy(*by))).groupBy(*by).agg(F.sum(F.col("_p") * F.col("_p")).alias("chance"))


def neighbour_kappa(neighbours: DataFrame, labels: DataFrame, by: Sequence[str] = ("attr",)) -> DataFrame:
    """(by, agree, chance, kappa) of k-NN neighbours: same-label share over all (query, neighbour) pairs against chance
    agreement of the pooled labels; null where chance is 1. ``labels`` has (id, by, value)."""
    q = labels.select(F.col("id").alias("query_id"), *by, F.col("value").alias("vq"))
    r = labels.select(F.col("id").alias("ref_id"), *by, F.col("value").alias("vr"))
    agree = neighbours.join(q, "query_id").join(r, ["ref_id", *by]).groupBy(*by).agg(F.avg((F.col("vq") == F.col("vr")).cast("double")).alias("agree"))
    out = agree.join(chance_agreement(labels, by), list(by))
    return out.withColumn("kappa", F.when(F.col("chance") < 1, (F.col("agree") - F.col("chance")) / (1 - F.col("chance"))))


def cohen_kappa(pairs: DataFrame, by: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """(by, n, agree, kappa): Cohen's kappa of paired labels; null where expected agreement is 1."""
    if not by:
        return cohen_kappa(pairs.withColumn("_all", F.lit(1)), ["_all"], a, b).drop("_all")
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("_n"))
    diag = cells.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("_n")).otherwise(0)).alias("_d"))
    side = lambda c, n: cells.groupBy(*by, F.col(c).alias("_v")).agg(F.sum("_n").alias(n))
    expected = side(a, "_x").join(side(b, "_y"), [*by, "_v"]).groupBy(*by).agg(F.sum(F.col("_x") * F.col("_y")).alias("_e"))
    out = diag.join(expected, list(by), "left").fillna(0, ["_e"])
    po, pe = F.col("_d") / F.col("n"), F.col("_e") / (F.col("n").cast("double") * F.col("n"))
    return out.select(*by, "n", po.alias("agree"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def macro_f1(pairs: DataFrame, by: Sequence[str], true: str = "a", pred: str = "b") -> DataFrame:
    """(by, accuracy, macro_f1): the F1 averaged over classes that occur as true labels; an undefined one is 0."""
    cells = pairs.where(F.col(true).isNotNull() & F.col(pred).isNotNull()).groupBy(*by, true, pred).agg(F.count(F.lit(1)).alias("_n"))
    t = cells.groupBy(*by, F.col(true).alias("_v")).agg(F.sum("_n").alias("_t"), F.sum(F.when(F.col(true) == F.col(pred), F.col("_n")).otherwise(0)).alias("_tp"))
    p = cells.groupBy(*by, F.col(pred).alias("_v")).agg(F.sum("_n").alias("_p"))
    f1 = 2 * F.col("_tp") / (F.col("_t") + F.coalesce("_p", F.lit(0)))
    return t.join(p, [*by, "_v"], "left").groupBy(*by).agg((F.sum("_tp") / F.sum("_t")).alias("accuracy"), F.avg(f1).alias("macro_f1"))


def confusion(pairs: DataFrame, classes: DataFrame, by: Sequence[str], smooth: float = 0.1, true: str = "a", pred: str = "b") -> DataFrame:
    """(by, a, b, p): row-normalised confusion over all class pairs, each cell raised by ``smooth``; other labels do not count.

    ``classes`` has (by, value): a closed vocabulary, so its pairs are few.
    """
    grid = classes.select(*by, F.col("value").alias(true)).join(classes.select(*by, F.col("value").alias(pred)), list(by))
    counts = pairs.groupBy(*by, true, pred).agg(F.count(F.lit(1)).alias("_n"))
    cells = grid.join(counts, [*by, true, pred], "left").withColumn("_n", F.coalesce("_n", F.lit(0)) + F.lit(smooth))
    return cells.withColumn("p", F.col("_n") / F.sum("_n").over(Window.partitionBy(*by, true))).drop("_n")


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
    """min |Ax - b| with x >= 0, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, dtype=bool)
    for _ in range(10 * n):
        slope = a.T @ (b - a @ x)
        if passive.all() or slope[~passive].max() <= tolerance:
            break
        passive[np.flatnonzero(~passive)[slope[~passive].argmax()]] = True
        while True:
            z = np.zeros(n)
            z[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if z[passive].min() > 0:
                break
            low = passive & (z <= 0)
            step = (x[low] / (x[low] - z[low])).min()
            x = x + step * (z - x)
            passive &= x > tolerance
            x[~passive] = 0
        x = z
    return x


def corrected_marginal(confusion_rows: np.ndarray, predicted: np.ndarray) -> np.ndarray:
    """The distribution of true labels that a classifier with these confusion rows turns into the predicted one."""
    x = nonnegative_least_squares(confusion_rows.T, predicted)
    return x / x.sum() if x.sum() > 0 else predicted


def mutual_information(labels: DataFrame, ident: str = "id") -> DataFrame:
    """(attr_a, attr_b, nmi) of all pairs of attributes: mutual information over the mean entropy; 1 for two constants.

    ``labels`` has (id, attr, value). The pairs of a record are built inside its row, without a self-join.
    """
    wide = labels.where("value is not null").groupBy(ident).agg(F.sort_array(F.collect_list(F.struct("attr", "value"))).alias("v"))
    a = wide.select(F.explode("v").alias("a"), "v").select("a", F.explode("v").alias("b")).where("a.attr <= b.attr")
    cells = a.groupBy(F.col("a.attr").alias("attr_a"), F.col("b.attr").alias("attr_b"), F.col("a.value").alias("x"), F.col("b.value").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    pair = ["attr_a", "attr_b"]
    p = cells.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*pair)))
    p = p.withColumn("px", F.sum("p").over(Window.partitionBy(*pair, "x"))).withColumn("py", F.sum("p").over(Window.partitionBy(*pair, "y")))
    sums = p.groupBy(*pair).agg(
        F.sum(F.col("p") * F.log(F.col("p") / (F.col("px") * F.col("py")))).alias("mi"),
        (-F.sum(F.col("p") * F.log("px"))).alias("hx"),
        (-F.sum(F.col("p") * F.log("py"))).alias("hy"),
    )
    mean = (F.col("hx") + F.col("hy")) / 2
    return sums.select(*pair, F.when((F.col("attr_a") == F.col("attr_b")) | (mean < 1e-12), 1.0).otherwise(F.greatest(F.col("mi"), F.lit(0.0)) / mean).alias("nmi"))
