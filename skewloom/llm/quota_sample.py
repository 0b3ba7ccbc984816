"""Samples that match target category proportions.

One pass keeps, in every input partition, a bottom-k reservoir per category and per joint cell:
the rows with the smallest hash of their id. Reservoirs of the same key merge by keeping the
smallest again, so any partitioning gives the same sample, and a repeated row cannot enter twice.
A reservoir that is not full is its whole category, which makes the shortfall report exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .common import blank, join_unique, plain

CELL = "joint cell"
#: Label of a missing value in a joint cell; plain labels hold letters and digits only.
MISSING = "\x1e"
#: Label, in a joint cell, of values that no target of the stratum names.
UNASKED = "\x1d"
#: Targets that a join may broadcast: at a hundred bytes each, 10 MB.
MAX_TARGETS = 100_000


def labelled_rows(df: DataFrame, stratum: str, id_col: str, text_col: str, attributes: list[str], length: str, width: int = 50) -> DataFrame:
    """(stratum, id, one column per attribute) of rows with text; plain compare, lengths to the nearest ``width`` (half to even)."""
    near = (F.bround(F.col(length) / float(width)) * width).cast("bigint").cast("string")
    label = {a: near if a == length else plain(F.col(a)) for a in attributes}
    rows = df.where(~blank(F.col(text_col)) & F.col(id_col).isNotNull() & F.col(stratum).isNotNull())
    return rows.select(F.col(stratum).alias("stratum"), F.col(id_col).alias("id"), *(label[a].alias(a) for a in attributes))


def target_table(targets: DataFrame, stratum: str) -> DataFrame:
    """(stratum, attr, label, category, need, k): what each stratum must get, once per category."""
    need = F.greatest(F.col("share") * F.col("k"), F.coalesce(F.col("min_rows"), F.lit(0)).cast("double"))
    return (
        targets.select(F.col(stratum).alias("stratum"), "attr", "category", plain("category").alias("label"), "share", "k", "min_rows", need.alias("need"))
        .where("stratum is not null and attr is not null and category is not null and need is not null")
        .dropDuplicates(["stratum", "attr", "label"])
    )


def _smallest(code: np.ndarray, draw: np.ndarray, ident: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of each code that have one of its ``capacity`` smallest draws, in order; a repeated row counts once."""
    order = np.lexsort((draw, code))
    code, draw, ident = code[order], draw[order], ident[order]
    fresh = np.r_[True, code[1:] != code[:-1]]
    step = fresh | np.r_[True, draw[1:] != draw[:-1]]
    rank = np.cumsum(step)
    first = np.flatnonzero(fresh)
    rank -= np.repeat(rank[first], np.diff(np.r_[first, len(code)]))
    keep = (rank < capacity) & (step | np.r_[True, ident[1:] != ident[:-1]])
    return code[keep], draw[keep], ident[keep]


#: Rows that a task collects before it cuts its reservoirs back to their capacity.
BUFFER_ROWS = 200_000
#: Parts in which the reservoirs that tasks send for one category are merged before the last merge.
MERGE_PARTS = 16


def reservoirs(
    rows: DataFrame, attributes: list[str], capacity: int, seed: int = 0, joint: bool = True, incomplete: bool = False, single: bool = True
) -> DataFrame:
    """(stratum, attr, label, id, draw): the merged bottom-``capacity`` reservoir of every category and joint cell.

    The attribute of a joint cell is ``CELL`` and its label joins the labels; ``joint=False`` leaves these out, and
    ``single=False`` the categories. Rows with a null label are in no category of that attribute, and in no joint cell
    unless ``incomplete``, where a null counts as ``MISSING``. ``draw`` is the hash that ranks the ids. A task codes keys as
    numbers and sorts whole buffers, so its cost does not depend on how many categories share the rows.
    """
    part = {a: F.coalesce(F.col(a), F.lit(MISSING)) if incomplete else F.col(a) for a in attributes}
    cell = F.concat(*(x for a in attributes for x in (F.lit("\x1f"), part[a])))  # null if one of them is
    keys = [*attributes * single, *[CELL] * joint]
    keyed = rows.withColumn("draw", F.xxhash64(F.lit(seed), F.col("id"))).withColumn(CELL, F.substring(cell, 2, 1 << 30)).select("stratum", "id", "draw", *keys)

    def one_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names: dict[tuple, int] = {}
        held: list[tuple] = []
        kept, size = 0, 0

        def cut() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return _smallest(*(np.concatenate(x) for x in zip(*held)), capacity)

        for b in batches:
            at, strata = pd.factorize(b["stratum"])
            draw, ident = b["draw"].to_numpy(), b["id"].to_numpy()
            for attr in keys:
                label, labels = pd.factorize(b[attr])
                own = np.flatnonzero(label >= 0)
                pair, back = np.unique(at[own] * np.int64(len(labels) + 1) + label[own], return_inverse=True)
                code = np.array([names.setdefault((strata[x // (len(labels) + 1)], attr, labels[x % (len(labels) + 1)]), len(names)) for x in pair.tolist()], dtype=np.int64)
                if len(own):
                    held.append((code[back], draw[own], ident[own]))
                    size += len(own)
            if size > kept + BUFFER_ROWS:
                held = [cut()]
                kept = size = len(held[0][0])
        if held:
            known = np.empty(len(names), dtype=object)
            known[:] = list(names)
            code, draw, ident = cut()
            for begin in range(0, len(code), 20_000):
                part = slice(begin, begin + 20_000)
                stratum, attr, label = zip(*known[code[part]])
                yield pd.DataFrame({"stratum": stratum, "attr": attr, "label": label, "id": ident[part], "draw": draw[part]})

    kinds = dict(rows.dtypes)
    sent = keyed.mapInPandas(one_pass, f"stratum {kinds['stratum']}, attr string, label string, id {kinds['id']}, draw bigint")
    # A category's reservoirs, one of each task, merge in parts by id first, so that no task gets those of all tasks.
    sent = sent.withColumn("_s", F.pmod("draw", F.lit(MERGE_PARTS)))
    w = Window.partitionBy("stratum", "attr", "label", "_s").orderBy("draw", "id")
    once = sent.withColumn("_d", F.lag("id").over(w).eqNullSafe(F.col("id"))).where(~F.col("_d"))
    few = once.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= capacity)
    whole = Window.partitionBy("stratum", "attr", "label").orderBy("draw", "id")
    return few.withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= capacity).select("stratum", "attr", "label", "id", "draw")


def shortfalls(rows: DataFrame, targets: DataFrame, attributes: list[str], seed: int = 0) -> DataFrame:
    """(stratum, attr, category, need, available) of every target that its rows cannot meet.

    ``available`` counts distinct ids and is exact, as a category short of its need fits its reservoir.
    """
    capacity = _capacity(targets)
    held = reservoirs(rows, attributes, capacity, seed, joint=False)
    have = held.groupBy("stratum", "attr", "label").agg(F.count(F.lit(1)).alias("available"))
    return (
        targets.join(have, ["stratum", "attr", "label"], "left")
        .withColumn("available", F.coalesce("available", F.lit(0).cast("bigint")))
        .where(F.col("available") < F.col("need"))
        .select("stratum", "attr", "category", "need", "available")
    )


def _capacity(targets: DataFrame) -> int:
    """Rows a reservoir must hold: the largest sample or need."""
    top = targets.agg(F.max(F.ceil("need")), F.max("k")).first()
    return max(1, int(top[0] or 0), int(top[1] or 0))


def _foldable(once: DataFrame, targets: DataFrame, attributes: list[str]) -> DataFrame:
    """``once`` with ``_<attribute>``: the label if the stratum has a target for it, ``UNASKED`` if not, null if missing.

    So a stratum has at most the product of its targets' categories as joint cells, whatever labels its rows have.
    Rows of strata without targets drop out. The targets go along by broadcast up to ``MAX_TARGETS`` of them.
    """
    asked = targets.groupBy("stratum").agg(*(F.collect_set(F.when(F.col("attr") == a, F.col("label"))).alias(f"_{a}") for a in attributes))
    if targets.count() <= MAX_TARGETS:
        both = once.join(F.broadcast(asked), "stratum")
    else:
        both = join_unique(once, asked, ["stratum"], once.groupBy("stratum").agg(F.count(F.lit(1)).alias("_n")))
    folded = {f"_{a}": F.when(F.col(a).isNotNull(), F.when(F.array_contains(f"_{a}", F.col(a)), F.col(a)).otherwise(UNASKED)) for a in attributes}
    return both.withColumns(folded)


def quota_sample(rows: DataFrame, targets: DataFrame, attributes: list[str], seed: int = 0, sweeps: int = 300, incomplete: bool = False) -> DataFrame:
    """(stratum, id, one column per attribute): up to k rows per stratum whose shares follow all targets at once.

    Quotas of the joint cells come from proportional fitting of the cells to the goals of each attribute
    in turn, never above what a cell holds. Goals reserve the minimums first and share out what is left of
    k; whole numbers by largest remainder, then single rows change cells until no change brings a category
    closer to its minimum or goal. Each cell's reservoir is then trimmed to its quota in hash order,
    which is a uniform draw. Categories without a target count as one, which gets no rows unless the targets cannot
    fill k. With ``incomplete`` a row that lacks some labels can be drawn too, for an exhausted category of the
    labels it has or where k is not full. Empty rows or targets give an empty sample. An id whose versions
    differ in their labels counts in its most complete one, the smallest joint cell of these.
    """
    capacity = _capacity(targets)
    missing = sum((F.col(a).isNull().cast("int") for a in attributes), F.lit(0))
    once = rows.groupBy("stratum", "id").agg(F.min(F.struct(missing.alias("_m"), *attributes)).alias("_c")).select("stratum", "id", *(f"_c.{a}" for a in attributes))
    folded = _foldable(once, targets, attributes).select("stratum", F.struct("id", *attributes).alias("id"), *(F.col(f"_{a}").alias(a) for a in attributes))
    # An id in a reservoir carries its labels, as one string, so that the chosen rows need no second look at the table.
    carried = folded.select("stratum", F.to_json("id", {"ignoreNullFields": "false"}).alias("id"), *attributes)
    held = written(reservoirs(carried, attributes, capacity, seed, incomplete=incomplete, single=False))
    cells = held.groupBy("stratum", "label").agg(F.count(F.lit(1)).alias("have"))
    kind = dict(rows.dtypes)

    def fit(key: tuple, cell: pd.DataFrame, target: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("label", ignore_index=True)
        if not len(cell) or not len(target):
            return cell[["stratum", "label"]].head(0).astype({"label": object}).assign(quota=np.zeros(0, dtype=np.int64))
        quota = cell_quotas([x.split("\x1f") for x in cell["label"]], cell["have"].to_numpy(), target, attributes, sweeps)
        return pd.DataFrame({"stratum": key[0], "label": cell["label"], "quota": quota})

    # A stratum's cells are at most the product of its targets' categories, each a row of two numbers.
    # Fitting costs far more than a cell's bytes suggest, so strata are spread over all cores.
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cells, asked = (d.repartition(tasks, "stratum") for d in (cells, targets))
    quotas = cells.groupBy("stratum").cogroup(asked.groupBy("stratum")).applyInPandas(fit, f"stratum {kind['stratum']}, label string, quota bigint")
    w = Window.partitionBy("stratum", "label").orderBy("draw", "id")
    ranked = held.withColumn("_r", F.row_number().over(w))
    chosen = ranked.join(quotas, ["stratum", "label"]).where(F.col("_r") <= F.col("quota"))
    shape = ", ".join(f"`{c}` {kind[c]}" for c in ("id", *attributes))
    return chosen.select("stratum", F.from_json("id", shape).alias("_v")).select("stratum", "_v.*")


def sample_misses(sample: DataFrame, targets: DataFrame, attributes: list[str], rows: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """(stratum, attr, category, need, min_rows, drawn) of every target that the drawn sample leaves below its need.

    With the ``rows`` it was drawn from also ``available``, the distinct ids of the category as far as the need goes, and
    ``reason``: 'supply' where all of them are drawn, 'rounding' where less than one row is missing, 'minimums' where the
    attribute's minimums exceed k together, 'shares' where its needs do, else 'margins': the needs of different attributes
    exclude each other.
    """
    labels = F.array(*(F.struct(F.lit(a).alias("attr"), F.col(a).alias("label")) for a in attributes))
    drawn = sample.select("stratum", F.inline(labels)).groupBy("stratum", "attr", "label").agg(F.count(F.lit(1)).alias("drawn"))
    found = targets.join(drawn, ["stratum", "attr", "label"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0).cast("bigint")))
    named = ["stratum", "attr", "category", "need", "min_rows", "drawn"]
    if rows is None:
        return found.where(F.col("drawn") < F.col("need")).select(*named)
    have = reservoirs(rows, attributes, _capacity(targets), seed, joint=False).groupBy("stratum", "attr", "label").agg(F.count(F.lit(1)).alias("available"))
    whole = Window.partitionBy("stratum", "attr")
    least = F.least(F.coalesce("min_rows", F.lit(0)).cast("double"), F.col("available"))
    found = found.join(have, ["stratum", "attr", "label"], "left").withColumn("available", F.coalesce("available", F.lit(0).cast("bigint")))
    found = found.withColumn("_min", F.sum(least).over(whole)).withColumn("_need", F.sum(F.least("need", F.col("available").cast("double"))).over(whole))
    reason = F.when(F.col("drawn") >= F.col("available"), "supply").when(F.col("need") - F.col("drawn") < 1, "rounding")
    reason = reason.when(F.col("_min") > F.col("k"), "minimums").when(F.col("_need") > F.col("k") + 1e-6, "shares").otherwise("margins")
    return found.withColumn("reason", reason).where(F.col("drawn") < F.col("need")).select(*named, "available", "reason")


def goals(share: np.ndarray, least: np.ndarray, have: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(reserved, goal) of one attribute's categories: whole minimums, and these with what shares get of the rest of ``k``.

    Neither exceeds what a category has. Minimums that together exceed k are cut from the largest down, so that the small ones hold.
    """
    reserved = np.minimum(np.ceil(least), have).astype(np.int64)
    if reserved.sum() > k:
        level = max(x for x in range(k + 1) if np.minimum(reserved, x).sum() <= k)
        over = np.flatnonzero(reserved > level)
        reserved = np.minimum(reserved, level)
        reserved[over[: k - int(reserved.sum())]] += 1
    rest = np.maximum(share - reserved, 0.0)
    low, high = 0.0, 1e6
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if np.minimum(reserved + mid * rest, have).sum() <= k else (low, mid)
    return reserved, np.minimum(reserved + low * rest, have)


def cell_quotas(labels: list[list[str]], have: np.ndarray, target: pd.DataFrame, attributes: list[str], sweeps: int) -> np.ndarray:
    """Whole quotas of the joint cells of one stratum."""
    k = int(min(target["k"].max(), have.sum()))
    whole = np.array([MISSING not in x for x in labels])
    weight = have.astype(float) / max(have.sum(), 1)
    sides, pulls = [], []
    for i, a in enumerate(attributes):
        t = target[target["attr"] == a]
        if len(t):
            names, inverse = np.unique([x[i] for x in labels], return_inverse=True)
            asked = {label: (s * top, least) for label, s, top, least in zip(t["label"], t["share"].fillna(0), t["k"], t["min_rows"].fillna(0))}
            share, least = (np.array([asked.get(n, (0.0, 0.0))[j] for n in names], dtype=float) for j in (0, 1))
            held = np.bincount(inverse, have)
            reserved, want = goals(share, least, held, k)
            used_up = (want > held - 1e-6) & (want > 0)
            pulls.append((inverse, [(1000.0, reserved), (30.0, np.where(used_up, held, 0)), (1.0, np.floor(want + 1e-6))]))
            sides.append((inverse, want if want.sum() > 0 else held * k / have.sum()))
    size = np.where(whole, weight, 0.0) * k
    for _ in range(sweeps):
        before = size.copy()
        for inverse, want in sides:
            at = np.bincount(inverse, size, len(want))
            size = np.minimum(size * np.divide(want, at, out=np.zeros_like(want), where=at > 0)[inverse], have)
        if np.abs(size - before).max() < 1e-6:
            break
    size *= min(1.0, k / max(size.sum(), 1e-9))  # goals that exclude each other can leave more than k
    floor = np.minimum(np.floor(size + 1e-9), have).astype(np.int64)
    for worth in (np.where(size > 0, size - floor, -1.0), weight):  # what is left: largest remainders, then cells without a target
        while (left := k - int(floor.sum())) > 0:
            open_ = np.flatnonzero((floor < have) & (worth >= 0))
            if not len(open_):
                break
            floor[open_[np.argsort(-worth[open_], kind="stable")][:left]] += 1
    return _exchange(floor, have, size, pulls)


def _exchange(quota: np.ndarray, have: np.ndarray, size: np.ndarray, pulls: list, tries: int = 64) -> np.ndarray:
    """Moves single rows between cells as long as that lowers the weighted rows missing from the levels of ``pulls``.

    ``pulls`` has per attribute the category of every cell and (weight, level of every category) pairs. Every
    move lowers the sum by at least 1, so the moves end.
    """
    while True:
        more, less = [], []  # change of the sum by one row more or less in each cell, per attribute
        for inverse, levels in pulls:
            n = np.bincount(inverse, quota, len(levels[0][1]))
            more.append(-sum(w * (level > n) for w, level in levels)[inverse])
            less.append(sum(w * (level >= n) * (n > 0) for w, level in levels)[inverse])
        gain = np.where(quota < have, sum(more, np.zeros(len(quota))), 0.0)
        into = np.lexsort((quota - size, gain))[:tries]
        into = into[gain[into] < 0]
        best = None
        for i in into:
            delta = sum((np.where(inverse == inverse[i], 0.0, m[i] + x) for (inverse, _), m, x in zip(pulls, more, less)), np.zeros(len(quota)))
            delta[(quota == 0) | (np.arange(len(quota)) == i)] = np.inf
            j = np.lexsort((size - quota, delta))[0]
            if delta[j] <= -1 and (best is None or delta[j] < best[0]):
                best = (delta[j], i, j)
        if best is None:
            return quota
        quota[best[1]] += 1
        quota[best[2]] -= 1
