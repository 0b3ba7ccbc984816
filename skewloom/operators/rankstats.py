"""Small-sample statistics over per-attribute results."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import NORMAL, spearman_p, t_table


def average_rank(value: str, by: Sequence[str] = ()) -> Column:
    """Rank from 1, ties at their mean rank."""
    order = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(order) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, rho): rank correlation of complete pairs."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = d.withColumn("_rx", average_rank(x, by)).withColumn("_ry", average_rank(y, by))
    agg = (F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("rho"))
    return d.groupBy(*by).agg(*agg) if by else d.agg(*agg)


def leave_one_out(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(left_out, n, rho): the rank correlation without each key in turn. The table has one row per attribute."""
    names = df.select(F.col(key).alias("left_out"))
    return spearman(df.join(names, F.col(key) != F.col("left_out")), x, y, ["left_out"])


def fisher_interval(rho: Column, n: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Confidence bounds of a correlation by Fisher's z; null for n < 4 or |rho| = 1."""
    z = NORMAL.inv_cdf(0.5 + level / 2)
    half = F.lit(z) / F.sqrt(F.greatest(n - 3, F.lit(1)).cast("double"))
    safe = (n >= 4) & (F.abs(rho) < 1)
    at = F.atanh(F.when(safe, rho))
    return F.tanh(at - half), F.tanh(at + half)


def fisher_z(r1: Column, n1: Column, r2: Column, n2: Column) -> Column:
    """The standardised difference of two independent correlations; null where Fisher's z is undefined."""
    safe = (n1 >= 4) & (n2 >= 4) & (F.abs(r1) < 1) & (F.abs(r2) < 1)
    error = F.sqrt(1 / F.greatest(n1 - 3, F.lit(1)) + 1 / F.greatest(n2 - 3, F.lit(1)))
    return (F.atanh(F.when(safe, r1)) - F.atanh(F.when(safe, r2))) / error


def fisher_difference(r1: float, n1: int, r2: float, n2: int) -> tuple[float, float]:
    """(z, two-sided p) of the difference of two independent correlations; NaN where Fisher's z is undefined."""
    if min(n1, n2) < 4 or max(abs(r1), abs(r2)) >= 1:
        return math.nan, math.nan
    z = (math.atanh(r1) - math.atanh(r2)) / math.sqrt(1 / (n1 - 3) + 1 / (n2 - 3))
    return z, 2 * (1 - NORMAL.cdf(abs(z)))


def _ranks(values: np.ndarray) -> np.ndarray:
    order = np.unique(values, return_inverse=True, return_counts=True)
    last = np.cumsum(order[2])
    return (last - (order[2] - 1) / 2)[order[1]]


def permutation_p(x: Sequence[float], y: Sequence[float], draws: int = 20_000, exact_up_to: int = 9, seed: int = 0) -> float:
    """Two-sided permutation p-value of the rank correlation, exact for few values."""
    a, b = _ranks(np.asarray(x, float)), _ranks(np.asarray(y, float))
    a, b = a - a.mean(), b - b.mean()
    scale = math.sqrt((a * a).sum() * (b * b).sum())
    if scale == 0:
        return math.nan
    seen = abs((a * b).sum() / scale)
    if len(a) <= exact_up_to:
        every = (np.fromiter(itertools.chain.from_iterable(itertools.permutations(range(len(b)))), dtype=np.int8).reshape(-1, len(b)))
        r = b[every] @ a / scale
        return float((np.abs(r) >= seen - 1e-12).mean())
    draw = np.random.default_rng(seed)
    r = np.array([a @ draw.permutation(b) for _ in range(draws)]) / scale
    return float((np.abs(r) >= seen - 1e-12).mean())


def bootstrap_interval(x: Sequence[float], y: Sequence[float], draws: int = 2000, level: float = 0.95, seed: int = 0) -> tuple[float, float]:
    """Percentile interval of the rank correlation over resampled pairs that keep more than two different values on both sides."""
    a, b = np.asarray(x, float), np.asarray(y, float)
    draw, got = np.random.default_rng(seed), []
    for _ in range(draws):
        at = draw.integers(len(a), size=len(a))
        if len(set(a[at])) > 2 and len(set(b[at])) > 2:
            got.append(np.corrcoef(_ranks(a[at]), _ranks(b[at]))[0, 1])
    if not got:
        return math.nan, math.nan
    return tuple(np.percentile(got, [50 * (1 - level), 50 * (1 + level)]))


def spearman_with_p(df: DataFrame, x: str, y: str) -> tuple[float, float, int]:
    """(rho, p, n) on the driver; the table has one row per attribute."""
    r = spearman(df, x, y).first()
    return r["rho"], spearman_p(r["rho"], r["n"]), r["n"]


def with_t_interval(df: DataFrame, sd: str, n: str, out: str = "ci95") -> DataFrame:
    """Adds the half width of the 95% t-interval of a mean; null for n < 2."""
    quantiles = df.sparkSession.createDataFrame(t_table(), "_df int, _t double")  # 200 rows
    joined = df.join(F.broadcast(quantiles), F.least(F.col(n) - 1, F.lit(200)) == F.col("_df"), "left")
    return joined.withColumn(out, F.col("_t") * F.col(sd) / F.sqrt(F.col(n).cast("double"))).drop("_df", "_t")
