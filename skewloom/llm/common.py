"""Pieces shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written

#: Most hot keys a join may broadcast; the row limit of a hot key is raised until they fit.
MAX_HOT_KEYS = 10_000


def plain(c: Column) -> Column:
    """Plain compare: lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def terms(c: Column) -> Column:
    """A cell's terms: split at ; and |, trimmed, white space collapsed, lower case, blanks left out."""
    tidy = F.transform(
        F.split(F.lower(c), r"[;|]"),
        lambda t: F.trim(F.regexp_replace(t, r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]+", " ")),
    )
    return F.filter(tidy, lambda t: t != "")


def blank(c: Column) -> Column:
    """True for null and for text of white space only."""
    return ~F.coalesce(c.rlike(r"[^\s\p{Z}\x{85}\x{1c}-\x{1f}]"), F.lit(False))


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame, hot_rows: int | None = 100_000) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row per key, without a hot key in one task.

    ``counts`` has the keys and the number ``_n`` of their rows in ``left``. Keys above ``hot_rows``
    are joined by broadcast, the others by shuffle. A table of n rows has at most n / hot_rows such
    keys, and the limit grows with n so that they never exceed ``MAX_HOT_KEYS``. None: the caller
    knows that the table is too small for a hot key.
    """
    if hot_rows is None:
        return left.join(right, keys)
    hot = counts.where(F.col("_n") > hot_rows).select(*keys).limit(MAX_HOT_KEYS + 1).collect()
    if len(hot) > MAX_HOT_KEYS:
        return join_unique(left, right, keys, counts, hot_rows * 10)
    if not hot:
        return left.join(right, keys)
    names = F.broadcast(left.sparkSession.createDataFrame(hot, counts.select(*keys).schema))
    few = F.broadcast(right.join(names, keys, "left_semi"))
    rest = left.join(names, keys, "left_anti").join(right.join(names, keys, "left_anti"), keys)
    return left.join(few, keys).unionByName(rest)


def with_group_min(df: DataFrame, keys: list[str], value: str, out: str, least: int = 1, hot_rows: int | None = 100_000) -> DataFrame:
    """Adds the smallest ``value`` of each key group to its rows; groups under ``least`` rows drop out.

    The minimum is combined before the shuffle, and hot keys take the other way of ``join_unique``. Where these are looked
    for, the groups are written, so that the search and the join do not both compute them.
    """
    stats = df.groupBy(*keys).agg(F.min(value).alias(out), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    stats = stats if hot_rows is None else written(stats)
    return join_unique(df, stats.drop("_n"), keys, stats, hot_rows)


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts only."""
    h = F.xxhash64(*parts).bitwiseAND(F.lit((1 << 52) - 1))
    return (h.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
