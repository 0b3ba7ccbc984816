"""Queries of the small-sample family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.distributions import NORMAL
from ..operators.agreement import chance_agreement
from ..operators.rankstats import average_rank, bootstrap_interval, fisher_interval, leave_one_out, permutation_p, spearman, spearman_with_p
from . import data
from .catalog import query
from .labels_queries import _rounded

# One row per attribute: chance agreement of the private records against that of the pool.

_XY = [*data.PRIVATE_LONG_SQL, *data.POOL_LONG_SQL] + [
    f"{n} AS (SELECT attr, round(sum(p * p), 9) AS {c} FROM (SELECT attr, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY attr) AS p FROM {t} GROUP BY attr, value) GROUP BY attr)"
    for n, c, t in (("xs", "x", "plong"), ("ys", "y", "qlong"))
] + ["xy AS (SELECT attr, x, y FROM xs JOIN ys USING (attr))"]


def _xy(spark, sf_dir):
    side = lambda d, n: chance_agreement(d, ["attr"]).select("attr", F.round("chance", 9).alias(n))
    return side(data.private_long(spark, sf_dir), "x").join(side(data.pool_long(spark, sf_dir), "y"), "attr")


def _rank(c: str, source: str = "xy", by: str = "") -> str:
    p = f"PARTITION BY {by} " if by else ""
    q = f"PARTITION BY {by}, {c}" if by else f"PARTITION BY {c}"
    return f"rank() OVER ({p}ORDER BY {c}) + (count(*) OVER ({q}) - 1) / 2.0::DOUBLE"


@query(data.ctes(*_XY) + f"SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM (SELECT {_rank('x')} AS rx, {_rank('y')} AS ry FROM xy)")
def spearman_chance(spark, sf_dir):
    """Rank correlation of private and pool chance agreement."""
    return _rounded(spearman(_xy(spark, sf_dir), "x", "y"))


@query(f"SELECT l_orderkey, l_linenumber, {_rank('l_quantity', by='l_orderkey')} AS rank FROM lineitem")
def avg_ranks(spark, sf_dir):
    """Average ranks of the quantities within orders."""
    return data.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", average_rank("l_quantity", ["l_orderkey"]).alias("rank"))


_Z = NORMAL.inv_cdf(0.975)


@query(data.ctes(*_XY) + f", r AS (SELECT count(*) AS n, corr(rx, ry) AS rho FROM (SELECT {_rank('x')} AS rx, {_rank('y')} AS ry FROM xy)) SELECT round(rho, 6) AS rho, CASE WHEN n >= 4 AND abs(rho) < 1 THEN round(tanh(atanh(rho) - {_Z:.15f}::DOUBLE / sqrt(greatest(n - 3, 1))), 6) END AS low, CASE WHEN n >= 4 AND abs(rho) < 1 THEN round(tanh(atanh(rho) + {_Z:.15f}::DOUBLE / sqrt(greatest(n - 3, 1))), 6) END AS high FROM r")
def fisher_ci(spark, sf_dir):
    """Fisher interval of the rank correlation."""
    r = spearman(_xy(spark, sf_dir), "x", "y")
    low, high = fisher_interval(F.col("rho"), F.col("n"))
    return _rounded(r.select("rho", low.alias("low"), high.alias("high")))


@query(data.ctes(*_XY) + f", o AS (SELECT o.attr AS left_out, xy.x, xy.y FROM xy, xy o WHERE o.attr <> xy.attr) SELECT left_out, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM (SELECT left_out, {_rank('x', by='left_out')} AS rx, {_rank('y', by='left_out')} AS ry FROM o) GROUP BY left_out")
def leave_one_out_rho(spark, sf_dir):
    """Rank correlation without each attribute."""
    return _rounded(leave_one_out(_xy(spark, sf_dir), "attr", "x", "y"))


@query(data.ctes(*_XY) + f"SELECT attr, abs(floor({_rank('x')}) - floor({_rank('y')}))::BIGINT AS difference FROM xy")
def rank_table(spark, sf_dir):
    """Differences of whole ranks."""
    d = _xy(spark, sf_dir)
    return d.select("attr", F.abs(F.floor(average_rank("x")) - F.floor(average_rank("y"))).alias("difference"))


@query()
def perm_pvalue(spark, sf_dir):
    """Exact permutation and t p-values of the rank correlation: enumeration of a handful of values, so without SQL."""
    d = _xy(spark, sf_dir)
    rows = d.orderBy("attr").collect()  # a row per attribute
    rho, p, n = spearman_with_p(d, "x", "y")
    return spark.createDataFrame([(n, rho, p, permutation_p([r["x"] for r in rows], [r["y"] for r in rows]))], "n int, rho double, t_p double, permutation_p double")


@query()
def boot_ci(spark, sf_dir):
    """Bootstrap interval of the rank correlation, without SQL."""
    rows = _xy(spark, sf_dir).orderBy("attr").collect()  # a row per attribute
    low, high = bootstrap_interval([r["x"] for r in rows], [r["y"] for r in rows])
    return spark.createDataFrame([(float(low), float(high))], "low double, high double")


@query("SELECT user_id, count(*) AS events, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(arg_max(value, event_id) - arg_min(value, event_id), 6) AS change FROM events WHERE value IS NOT NULL GROUP BY user_id")
def event_profile(spark, sf_dir):
    """Mean, deviation and first-to-last change of every user's values."""
    e = data.table(spark, sf_dir, "events").where("value is not null")
    return _rounded(e.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), (F.max_by("value", "event_id") - F.min_by("value", "event_id")).alias("change")))


