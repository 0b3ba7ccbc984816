"""Summaries of run logs: baselines, paired differences, intervals, changes, best-of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rankstats import with_t_interval


def family(annotator: Column) -> Column:
    """What follows the first hyphen of an annotator's name; '' without one."""
    return F.when(annotator.contains("-"), F.regexp_extract(annotator, r"^[^-]*-(.*)$", 1)).otherwise("")


def is_baseline(annotator: Column, prefix: str) -> Column:
    """Whether the annotator is a family's baseline."""
    return annotator.startswith(prefix)


def replicate_baseline(df: DataFrame, prefix: str, lam: str = "lam") -> DataFrame:
    """Rows of a baseline at strength 0 appear under every other annotator of its family; under its own name if it is alone.

    Other rows stay, a baseline's rows at other strengths too.
    """
    f = df.withColumn("_f", family(F.col("annotator")))
    base = is_baseline(F.col("annotator"), prefix) & (F.col(lam) == 0)
    members = f.where(~is_baseline(F.col("annotator"), prefix)).select("_f", F.col("annotator").alias("_m")).distinct()
    shown = f.where(base).join(F.broadcast(members), "_f", "left").withColumn("annotator", F.coalesce("_m", "annotator"))  # a row per annotator
    return f.where(~base).drop("_f").unionByName(shown.select(*df.columns))


#: How the names of metric columns begin.
METRIC_PREFIXES = ("jsd_", "mauve", "marg_jsd", "cell_jsd")


def metric_columns(df: DataFrame, prefixes: Sequence[str] = METRIC_PREFIXES) -> list[str]:
    """Numeric columns whose names begin with one of the prefixes, in the table's order."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [c for c, kind in df.dtypes if (kind in numeric or kind.startswith("decimal")) and c.startswith(tuple(prefixes))]


def unpivot(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(ids, metric, value) of the values that are not null."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))
    return df.select(*ids, F.inline(pairs)).where("value is not null")


def mean_sd_n(long: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """(by, mean, sd, n, ci95): sample deviation, half width of the t-interval; null for one value."""
    agg = long.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    return with_t_interval(agg, "sd", "n")


def final_table(last: DataFrame, by: Sequence[str], metrics: Sequence[str], seed: str = "seed") -> DataFrame:
    """Mean of every metric and of the round, their deviations, seeds and whether all runs are done."""
    out = [F.count_distinct(seed).alias("seeds"), F.avg("round").alias("round")]
    for m in metrics:
        out += [F.avg(m).alias(m), F.stddev_samp(m).alias(f"{m}_sd")]
    if "done" in last.columns:
        out.append(F.bool_and("done").alias("done"))
    return last.groupBy(*by).agg(*out)


def paired_differences(rows: DataFrame, base: DataFrame, keys: Sequence[str], ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(ids, metric, mean, sd, n, ci95) of differences to the baseline row with the same ``keys``."""
    ref = base.select(*keys, *(F.col(m).alias(f"{m}_ref") for m in metrics))
    both = rows.join(ref, list(keys))
    return mean_sd_n(unpivot(both.withColumns({m: F.col(m) - F.col(f"{m}_ref") for m in metrics}), ids, metrics), [*ids, "metric"])


def paired_with_fallback(rows: DataFrame, base: DataFrame, exact: Sequence[str], loose: Sequence[str], order: str, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """As ``paired_differences``; rows without an exact partner take the first baseline row, by ``order``, that agrees in the ``loose`` keys."""
    first = Window.partitionBy(*loose).orderBy(order)
    any_ = base.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    ref = lambda d, keys: d.select(*keys, *(F.col(m).alias(f"{m}_ref") for m in metrics))
    own = rows.join(ref(base, exact), list(exact))
    rest = rows.join(base.select(*exact), list(exact), "left_anti").join(ref(any_, loose), list(loose))
    both = own.unionByName(rest.select(*own.columns))
    return mean_sd_n(unpivot(both.withColumns({m: F.col(m) - F.col(f"{m}_ref") for m in metrics}), ids, metrics), [*ids, "metric"])


def change_first_last(long: DataFrame, by: Sequence[str], run: Sequence[str], start: int, round_: str = "round") -> DataFrame:
    """(by, mean, sd, n, ci95, verdict) of last minus first value per run; runs must begin at ``start`` and have two rounds."""
    span = long.groupBy(*by, *run).agg(
        F.min(round_).alias("_a"), F.count_distinct(round_).alias("_n"), (F.max_by("value", round_) - F.min_by("value", round_)).alias("value")
    )
    out = mean_sd_n(span.where((F.col("_a") == start) & (F.col("_n") >= 2)), by)
    verdict = F.when(F.col("n") < 2, "n<2").when(F.abs("mean") <= F.col("ci95"), "n.s.").when(F.col("mean") > 0, "up").otherwise("down")
    return out.withColumn("verdict", verdict)


def pivot_first(df: DataFrame, index: Sequence[str], column: str, values: Sequence, value: str) -> DataFrame:
    """The first (least) value of each cell, one column per given value; rows with holes drop out."""
    return df.groupBy(*index).pivot(column, list(values)).agg(F.min(value)).dropna()


def best_of(long: DataFrame, by: Sequence[str], name: str, value: str) -> DataFrame:
    """(by, best, best_value, gap): the greatest value, its name (ties: the smaller), the lead over the second."""
    w = Window.partitionBy(*by).orderBy(F.col(value).desc(), F.col(name))
    ranked = long.withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    top = lambda k: F.max(F.when(F.col("_r") == k, F.col(value)))
    return ranked.groupBy(*by).agg(F.max(F.when(F.col("_r") == 1, F.col(name))).alias("best"), top(1).alias("best_value"), (top(1) - top(2)).alias("gap"))


def best_model(scores: DataFrame, by: Sequence[str], score: str, cost: str, allowed: DataFrame | None = None) -> DataFrame:
    """The row of the greatest score per key, ties by the lower cost; ``allowed`` keeps models that exist."""
    if allowed is not None:
        scores = scores.join(allowed, [c for c in allowed.columns], "left_semi")
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(cost))
    return scores.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def correction_table(per_selection: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, attr, pool, random, random_sd, floor, vote, correction): how much of the random selection's distance the vote removes.

    ``per_selection`` has (by, attr, kind, jsd) with kind pool, random, floor or vote; the random deviation
    is of the population. Null where random and floor differ by no more than two deviations.
    """
    of = lambda k, f=F.avg: f(F.when(F.col("kind") == k, F.col("jsd")))
    out = per_selection.groupBy(*by, "attr").agg(
        of("pool").alias("pool"), of("random").alias("random"), of("random", F.stddev_pop).alias("random_sd"), of("floor").alias("floor"), of("vote").alias("vote")
    )
    room = F.col("random") - F.col("floor")
    return out.withColumn("correction", F.when(room > 2 * F.col("random_sd"), (F.col("random") - F.col("vote")) / room))


def metric_means(jsd: DataFrame, blind: Sequence[str], klass: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, jsd_mean, jsd_blind_mean, jsd_other_mean) of (by, attr, jsd); 'other' leaves out blind and class attributes."""
    in_blind, in_class = F.col("attr").isin(list(blind)), F.col("attr").isin(list(klass))
    agg = (F.avg("jsd").alias("jsd_mean"), F.avg(F.when(in_blind, F.col("jsd"))).alias("jsd_blind_mean"), F.avg(F.when(~in_blind & ~in_class, F.col("jsd"))).alias("jsd_other_mean"))
    return jsd.groupBy(*by).agg(*agg) if by else jsd.agg(*agg)


def visibility_summary(per_repeat: DataFrame, classes: DataFrame, top: int = 3, exclude: Sequence[str] = ()) -> DataFrame:
    """(attr, n_classes, knn, knn_sd, probe, probe_sd, gap, blindness, selected) from (attr, repeat, knn, probe); least visible first are selected."""
    out = per_repeat.groupBy("attr").agg(F.avg("knn").alias("knn"), F.stddev_samp("knn").alias("knn_sd"), F.avg("probe").alias("probe"), F.stddev_samp("probe").alias("probe_sd"))
    out = out.join(classes, "attr").withColumn("gap", F.col("probe") - F.col("knn")).withColumn("blindness", 1 - F.col("knn"))
    w = Window.orderBy((~F.col("attr").isin(list(exclude))).desc(), F.col("blindness").desc(), "attr")  # a row per attribute
    return out.withColumn("selected", (F.row_number().over(w) <= top) & ~F.col("attr").isin(list(exclude)))
