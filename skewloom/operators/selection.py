"""Selection of candidates by score: top-K, quotas by cell, water-filling, per class.

Every operator works per run: ``run`` columns (a setting, a seed, a class) are part of every key, so
that many selections are one plan. Ties go to the smaller id.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def with_rank(df: DataFrame, run: Sequence[str], score: str = "score", ident: str = "cand_id", rank: str = "rank") -> DataFrame:
    """Rank by score, greatest first, then by id."""
    w = Window.partitionBy(*run).orderBy(F.col(score).desc(), F.col(ident).asc())
    return df.withColumn(rank, F.row_number().over(w))


#: Bound up to which Spark cuts ranked rows inside each partition before it moves them (its own default).
WINDOW_LIMIT = 1000


def top_k(df: DataFrame, k: int | DataFrame, run: Sequence[str] = (), score: str = "score", ident: str = "cand_id") -> DataFrame:
    """The k best rows of each run with their rank; ``k`` may be a table (run, k), one row per run.

    For a small k every partition cuts its runs before the merge. A larger one is ranked over ranges of scores, so that no
    task holds a run's best rows, however many they are.
    """
    if isinstance(k, int) and k <= WINDOW_LIMIT:
        if not run:
            df = df.orderBy(F.col(score).desc(), F.col(ident).asc()).limit(k)
        return with_rank(df, run, score, ident).where(F.col("rank") <= k)
    ranked = global_rank(df, run, [F.col(score).desc(), F.col(ident).asc()])
    if isinstance(k, int):
        return ranked.where(F.col("rank") <= k)
    return _with_k(ranked, k, run).where(F.col("rank") <= F.col("_k")).drop("_k")


def _with_k(df: DataFrame, k: int | DataFrame, run: Sequence[str]) -> DataFrame:
    """Adds ``_k``, each run's k. Runs are few beside the rows; Spark sends the table along if it is small."""
    if isinstance(k, int):
        return df.withColumn("_k", F.lit(k))
    own = k.select(*run, F.col("k").cast("bigint").alias("_k"))
    return df.join(own, list(run)) if run else df.join(F.broadcast(own))  # one row


def _ranges(df: DataFrame, order: Sequence[Column], parts: int | None = None) -> DataFrame:
    """The rows cut into ranges of ``order``, written with the number of their range as ``_part``."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))


def _before(placed: DataFrame, keys: Sequence[str], what: Column, out: str) -> DataFrame:
    """(keys, _part, out): the sum of ``what`` over the earlier ranges; as many rows as ranges and keys meet."""
    each = placed.groupBy(*keys, "_part").agg(F.sum(what).alias("_c"))
    w = Window.partitionBy(*keys).orderBy("_part")
    return each.withColumn(out, F.sum("_c").over(w) - F.col("_c")).drop("_c")


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys that may be null."""
    other = right.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(keys)), *(c for c in right.columns if c not in keys))
    same = reduce(operator.and_, (F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(keys)))
    return left.join(other, same, "left").drop(*(f"_{i}" for i in range(len(keys))))


def global_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "rank", parts: int | None = None) -> DataFrame:
    """Adds the row number within ``keys`` by ``order``, from 1, without a task that holds all rows of a key.

    The rows are cut into ranges of (keys, order); a row's number is that within its range plus the rows of its key in
    earlier ranges. The order must be total.
    """
    placed = _ranges(df, [*(F.col(c) for c in keys), *order], parts)
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    both = _null_safe(placed.withColumn("_i", inside), _before(placed, keys, F.lit(1), "_b"), [*keys, "_part"])
    return both.withColumn(out, (F.col("_i") + F.col("_b")).cast("bigint")).drop("_i", "_b", "_part")


def largest_remainder(weights: DataFrame, total: int | Column, run: Sequence[str], key: str, weight: str = "w", out: str = "quota") -> DataFrame:
    """Whole shares of ``total`` in proportion to ``weight``: floors, then one more for the largest fractions, ties by key.

    Weights that sum to 0 give zeros. Fractions are rounded to 9 places before they are ranked.
    """
    total = F.lit(total) if isinstance(total, int) else total
    whole = Window.partitionBy(*run)
    share = F.when(F.sum(weight).over(whole) > 0, total * F.col(weight) / F.sum(weight).over(whole)).otherwise(0.0)
    d = weights.withColumn("_s", F.round(share, 9)).withColumn("_f", F.floor("_s"))
    by_fraction = Window.partitionBy(*run).orderBy(F.round(F.col("_s") - F.col("_f"), 9).desc(), F.col(key).asc())
    left = F.round(F.sum("_s").over(whole)) - F.sum("_f").over(whole)
    more = (F.row_number().over(by_fraction) <= left).cast("bigint")
    return d.withColumn(out, F.col("_f") + more).drop("_s", "_f")


def cell_quotas(base: DataFrame, target: DataFrame, strength: float | Column, k: int | Column | DataFrame, run: Sequence[str], cell: str = "cell") -> DataFrame:
    """(run, cell, quota): weights P^strength * R^(1 - strength) over the cells of either side, with 0^0 = 1.

    ``base`` has (run, cell, r), the share of each cell in plain top-K; ``target`` has (cell, p), and
    may have run columns. ``k`` may be a table (run, k).
    """
    strength = F.lit(strength) if isinstance(strength, (int, float)) else strength
    shared = [c for c in run if c in target.columns]
    runs = base.select(*run).distinct() if run else None
    every = target if not run or shared == list(run) else (runs.join(target, shared) if shared else runs.crossJoin(F.broadcast(target)))
    both = base.join(every, [*run, cell], "full_outer").fillna(0.0, ["r", "p"])
    if isinstance(k, DataFrame):
        both, k = _with_k(both, k, run), F.col("_k")
    return largest_remainder(both.withColumn("w", F.pow("p", strength) * F.pow("r", 1 - strength)), k, run, cell).select(*run, cell, "quota", "p", "r")


def select_by_quota(
    candidates: DataFrame, quotas: DataFrame, k: int | DataFrame, run: Sequence[str] = (), cell: str = "cell", score: str = "score", ident: str = "cand_id"
) -> DataFrame:
    """The best ``quota`` rows of every cell, filled up to k by the best of the rest; ``k`` may be a table (run, k).

    Adds ``by_quota`` (false for filled rows) and ``in_base`` (whether plain top-K takes the row too).
    For a k up to ``WINDOW_LIMIT`` a row with k better ones in its cell can never be chosen; as a literal bound this lets Spark
    cut every cell, and then every run, inside each partition before the shuffle. A larger k is selected over ranges of scores.
    """
    best = (F.col(score).desc(), F.col(ident).asc())
    if not isinstance(k, int) or k > WINDOW_LIMIT:
        return _select_in_ranges(candidates, quotas, k, run, cell, best)
    inside = candidates.withColumn("_c", F.row_number().over(Window.partitionBy(*run, cell).orderBy(*best))).where(F.col("_c") <= k)
    placed = inside.join(quotas.select(*run, cell, "quota"), [*run, cell], "left")
    placed = placed.withColumn("by_quota", F.coalesce(F.col("_c") <= F.col("quota"), F.lit(False)))
    order = Window.partitionBy(*run).orderBy(F.col("by_quota").desc(), *best)
    chosen = placed.withColumn("_o", F.row_number().over(order)).where(F.col("_o") <= k).drop("_c", "_o", "quota")
    base = top_k(candidates, k, run, score, ident).select(*run, ident, F.lit(True).alias("_b"))
    return chosen.join(base, [*run, ident], "left").withColumn("in_base", F.coalesce("_b", F.lit(False))).drop("_b")


def _select_in_ranges(candidates: DataFrame, quotas: DataFrame, k: int | DataFrame, run: Sequence[str], cell: str, best: tuple) -> DataFrame:
    """The same for any k: one range partitioning by (run, score) gives every rank, as sums over earlier ranges and rows of the own range."""
    run = list(run)
    placed = _ranges(candidates, [*(F.col(c) for c in run), *best])
    own, in_cell = Window.partitionBy(*run, "_part").orderBy(*best), Window.partitionBy(*run, "_part", cell).orderBy(*best)
    d = placed.withColumn("_i", F.row_number().over(own)).withColumn("_j", F.row_number().over(in_cell))
    d = _null_safe(d, _before(placed, run, F.lit(1), "_bi"), [*run, "_part"])
    d = _null_safe(d, _before(placed, [*run, cell], F.lit(1), "_bj"), [*run, cell, "_part"])
    d = _with_k(d.join(quotas.select(*run, cell, "quota"), [*run, cell], "left"), k, run)
    d = d.withColumn("by_quota", F.coalesce(F.col("_j") + F.col("_bj") <= F.col("quota"), F.lit(False))).withColumn("in_base", F.col("_i") + F.col("_bi") <= F.col("_k"))
    marked = written(d.drop("_i", "_j", "_bi", "_bj", "quota"))
    rest = (~F.col("by_quota")).cast("bigint")
    taken = marked.groupBy(*run).agg(F.sum(F.col("by_quota").cast("bigint")).alias("_t"))
    d = marked.withColumn("_f", F.sum(rest).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    d = _null_safe(d, _before(marked, run, rest, "_bf"), [*run, "_part"])
    d = _null_safe(d, taken, run) if run else d.join(F.broadcast(taken))  # one row
    keep = F.col("by_quota") | (F.col("_f") + F.col("_bf") <= F.col("_k") - F.col("_t"))
    return d.where(keep).select(*candidates.columns, "by_quota", "in_base")


def quota_select(
    candidates: DataFrame, target: DataFrame, strength: float | Column, k: int | DataFrame, run: Sequence[str] = (), score: str = "score", cell: str = "cell"
) -> DataFrame:
    """Top-K steered to target shares of joint cells: base shares, quotas, best of each cell, water-filling."""
    size = Window.partitionBy(*run)
    base = top_k(candidates, k, run, score).groupBy(*run, cell).agg(F.count(F.lit(1)).alias("_n"))
    base = base.withColumn("r", F.col("_n") / F.sum("_n").over(size)).drop("_n")
    return select_by_quota(candidates, cell_quotas(base, target, strength, k, run, cell), k, run, cell, score)


def selection_info(selected: DataFrame, k: int, run: Sequence[str] = ()) -> DataFrame:
    """(run, chosen, shortfall, moved): rows, rows that only water-filling chose, rows that plain top-K does not take."""
    moved = F.lit(k) - F.sum(F.col("in_base").cast("bigint"))
    agg = (F.count(F.lit(1)).alias("chosen"), F.sum((~F.col("by_quota")).cast("bigint")).alias("shortfall"), moved.alias("moved"))
    return selected.groupBy(*run).agg(*agg) if run else selected.agg(*agg)


def keep_cells(labels: DataFrame, cell: str, most: int, other: str = "__other__") -> DataFrame:
    """(cell, p): shares of the joint cells; above ``most`` cells the rarest become one, ties by cell."""
    counts = labels.groupBy(cell).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.col("n").desc(), F.col(cell).asc())  # over cells, not rows
    ranked = counts.withColumn("_r", F.row_number().over(w)).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy()))
    kept = ranked.withColumn(cell, F.when((F.col("_m") > most) & (F.col("_r") > most - 1), other).otherwise(F.col(cell)))
    return kept.groupBy(cell).agg(F.sum("n").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy())).drop("n")


def assign_cells(labels: DataFrame, kept: DataFrame, cell: str, other: str = "__other__") -> DataFrame:
    """Cells that are not kept become ``other``."""
    names = F.broadcast(kept.select(F.col(cell).alias("_k")))  # as many rows as cells are kept
    return labels.join(names, F.col(cell) == F.col("_k"), "left").withColumn(cell, F.coalesce("_k", F.lit(other))).drop("_k")


def survivors_per_class(counts: DataFrame, n: int, klass: str = "class", count: str = "n") -> DataFrame:
    """(class, k): n survivors in proportion to the class counts, by largest remainder; a class without any is an error."""
    out = largest_remainder(counts.withColumn("w", F.col(count).cast("double")), n, [], klass, out="k").drop("w")
    none = F.raise_error(F.concat(F.lit("no survivor for class "), F.col(klass).cast("string")))
    return out.withColumn("k", F.when(F.col("k") > 0, F.col("k")).otherwise(none.cast("bigint"))).select(klass, "k")
