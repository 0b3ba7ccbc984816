"""Frequency of every distinct term, by occurrence and by record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binding import bound
from .common import terms


def latest(df: DataFrame, id_col: str, columns: list[str], order: str) -> DataFrame:
    """The last delivered version of each record, by ``order`` and then by content; null ids drop out.

    The aggregate combines before the shuffle, so a record delivered very often stays one row per task.
    """
    last = F.max(F.struct(F.col(order).alias("_o"), *columns)).alias("_r")
    return df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(last).select(id_col, *(f"_r.{c}" for c in columns))


def term_frequency(
    df: DataFrame, id_col: str, columns: list[str], order: str, rare_records: int = 2, common_share: float = 0.10
) -> DataFrame:
    """(attr, term, occurrences, records, share, mark) of every term of ``columns``.

    Every record counts once, in its last version. Counts per record are made inside the row, so
    only (attr, term) partial sums are shuffled and a term in a third of all records costs no more
    than another. ``mark``: 'rare' up to ``rare_records`` records, else 'common' above
    ``common_share`` of all distinct ids, else null. Nulls and blank cells hold no term but their
    records count as records. An empty table gives no rows.
    """
    records = latest(df, id_col, columns, order)
    found = F.concat(*(_counts(F.lit(c), F.col(c)) for c in columns))
    per_record = records.select(F.explode(found).alias("t")).select("t.*")
    total = df.agg(F.count_distinct(id_col).alias("_total"))
    counted = per_record.groupBy("attr", "term").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("records"))
    share = F.col("records") / F.col("_total")
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") > common_share * F.col("_total"), "common")
    return (
        counted.join(F.broadcast(total))  # one row
        .select("attr", "term", "occurrences", "records", share.alias("share"), mark.alias("mark"))
    )


def _counts(attr, cell):
    """[(attr, term, n)] of one cell, by the runs of its sorted terms; null gives an empty list."""
    found = F.array_sort(F.coalesce(terms(cell), F.array().cast("array<string>")))

    def runs(own):
        begins = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: (i == 0) | ~F.get(own, i).eqNullSafe(F.get(own, i - 1)))
        ends = F.concat(F.slice(begins, F.lit(2), F.size(begins)), F.array(F.size(own)))
        return F.zip_with(begins, ends, lambda i, j: F.struct(attr.alias("attr"), F.get(own, i).alias("term"), (j - i).cast("bigint").alias("n")))

    none = F.array().cast("array<struct<attr:string,term:string,n:bigint>>")
    return bound(found, lambda own: F.when(F.size(own) == 0, none).otherwise(runs(own)))
