"""Histograms on quantile edges and importance weights."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Edges of the length histogram in words.
LENGTH_EDGES = tuple(range(25, 1000, 50))


#: Cells of equal width in which ranks are counted.
CELLS = 4096


#: Values of a cell from which it is cut into cells again.
MOST_IN_CELL = 100_000


def exact_quantiles(df: DataFrame, features: Sequence[str], shares: Sequence[float]) -> dict[str, list[float]]:
    """Quantiles of each feature by linear interpolation; none for a feature without values. NaN does not count.

    A pass counts the values in cells of equal width, which gives the cell of every wanted rank. Cells that hold many values are
    cut again between their own least and greatest value, as often as needed, so an outlier that throws all others into one
    cell costs one more pass. The last pass sorts only the cells of the wanted ranks; no task sees all values.
    """
    spark = df.sparkSession
    parts = F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("x")) for f in features))
    long = df.select(F.inline(parts)).where("x is not null and not isnan(x)")
    span = {r["f"]: (r["a"], r["b"], r["n"]) for r in long.groupBy("f").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count(F.lit(1)).alias("n")).collect()}
    ranks = {f: sorted({k for s in shares for k in (int(s * (n - 1)), min(int(s * (n - 1)) + 1, n - 1))}) for f, (_, _, n) in span.items()}
    value: dict[tuple[str, int], float] = {}
    # (feature, least, greatest, values, values before it): the cells that hold wanted ranks; two per share at most.
    open_ = [(f, a, b, n, 0) for f, (a, b, n) in span.items()]
    small = []
    while open_:
        known = F.broadcast(spark.createDataFrame([(f, k, float(a), float(b)) for k, (f, a, b, _, _) in enumerate(open_)], "f string, k int, a double, b double"))
        inside = long.join(known, "f").where((F.col("x") >= F.col("a")) & (F.col("x") <= F.col("b")))
        width = F.col("b") / CELLS - F.col("a") / CELLS  # cannot overflow
        cell = F.when(width > 0, F.least(F.floor((F.col("x") / CELLS - F.col("a") / CELLS) / width * CELLS), F.lit(CELLS - 1))).otherwise(0).cast("int")
        counts = inside.groupBy("k", cell.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).collect()  # at most CELLS numbers per cell
        cut = []
        for k, (f, _, _, n, before) in enumerate(open_):
            total, todo = before, [r for r in ranks[f] if before <= r < before + n]
            for r in sorted((r for r in counts if r["k"] == k), key=lambda r: r["c"]):
                own = [x for x in todo if total <= x < total + r["n"]]
                if own and r["a"] == r["b"]:
                    value.update({(f, x): r["a"] for x in own})
                elif own:
                    (cut if r["n"] > MOST_IN_CELL else small).append((f, r["a"], r["b"], r["n"], total))
                total += r["n"]
        open_ = cut
    if small:
        known = F.broadcast(spark.createDataFrame([(f, float(a), float(b), before) for f, a, b, _, before in small], "f string, a double, b double, before bigint"))
        ties = long.join(known, "f").where((F.col("x") >= F.col("a")) & (F.col("x") <= F.col("b"))).groupBy("f", "before", "x").agg(F.count(F.lit(1)).alias("m"))
        upto = ties.withColumn("u", F.sum("m").over(Window.partitionBy("f", "before").orderBy("x")) + F.col("before"))
        asked = F.broadcast(spark.createDataFrame([(f, before, r) for f, _, _, n, before in small for r in ranks[f] if before <= r < before + n], "f string, before bigint, r bigint"))
        hit = upto.join(asked, ["f", "before"]).where((F.col("u") > F.col("r")) & (F.col("u") - F.col("m") <= F.col("r")))
        value.update({(r["f"], r["r"]): r["x"] for r in hit.collect()})  # one row per wanted rank
    out: dict[str, list[float]] = {f: [] for f in features}
    for f, (_, _, n) in span.items():
        for s in shares:
            at = s * (n - 1)
            a, b = value[f, int(at)], value[f, min(int(at) + 1, n - 1)]
            out[f].append(a + (b - a) * (at - int(at)))
    return out


def decile_edges(df: DataFrame, features: Sequence[str]) -> dict[str, list[float]]:
    """The distinct deciles of each feature."""
    return {f: sorted(set(q)) for f, q in exact_quantiles(df, features, [k / 10 for k in range(1, 10)]).items()}


def bin_of(x: Column, edges: Column) -> Column:
    """Number of edges that are not above the value."""
    return F.size(F.filter(edges, lambda e: e <= x))


def bin_among(x: Column, edges: Sequence[float]) -> Column:
    """``bin_of`` for edges known when the plan is made, as compiled comparisons."""
    return reduce(lambda a, b: a + b, ((x >= F.lit(e)).cast("int") for e in edges), F.lit(0))


def length_weights(q: DataFrame, p: DataFrame, bin_: str) -> DataFrame:
    """Adds ``weight`` to the rows of ``q`` so that its bins weigh as those of ``p``, and ``covered``, the share of ``p`` in bins of q."""
    share = lambda d, n: d.groupBy(bin_).agg(F.count(F.lit(1)).alias("_c")).withColumn(n, F.col("_c") / F.sum("_c").over(Window.partitionBy())).drop("_c")
    both = share(p, "_p").join(share(q, "_q"), bin_)
    out = both.withColumn("weight", F.col("_p") / F.col("_q")).withColumn("covered", F.sum("_p").over(Window.partitionBy()))
    return q.join(F.broadcast(out.select(bin_, "weight", "covered")), bin_)  # a row per bin


def nearest_bin(values: DataFrame, bins: DataFrame, value: str, bin_: str) -> DataFrame:
    """Adds ``nearest``: the closest bin, the smaller one on ties. Bins are few, so they go along as an array."""
    every = bins.agg(F.sort_array(F.collect_set(bin_)).alias("_bins"))
    d = values.join(F.broadcast(every))  # one row
    return d.withColumn("nearest", F.array_min(F.transform("_bins", lambda b: F.struct(F.abs(b - F.col(value)).alias("d"), b.alias("b"))))["b"]).drop("_bins")
