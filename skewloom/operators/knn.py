"""Exact nearest-neighbour joins.

The reference side is cut into blocks of bounded size; every block meets every query batch as one
matrix product, and only the k best of a block leave it. The best of all blocks are then merged. A single
block is sent along with the function; more blocks meet blocks of queries in a grid of bounded
tasks, so neither side has to fit a task. The single nearest reference is found in single precision with
a bound on its error; whatever lies within the bound is compared in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

#: Vectors of a reference block: 20,000 of 768 single floats are 60 MB.
BLOCK_ROWS = 20_000
#: Blocks of short vectors may be so many times larger, as long as the grid keeps so many tasks: less is sent twice.
WIDER, GRID_TASKS = 4, 64
#: Partitions for each block pair, so that few share one and none waits for another's, and the most of them.
SPREAD, MOST_PARTITIONS = 4, 2_000
#: Queries and references of a tile: 1,024 x 512 single floats stay near a core.
TILE = 1024, 512
#: Classes whose numbers of blocks a join may broadcast.
MAX_CLASSES = 100_000


def nearest(queries: DataFrame, refs: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """(query_id, ref_id, distance, rank): the k nearest references by Euclidean distance, ties by the smaller id.

    Both frames have ``id`` and ``vector``, and with ``by`` a class of that name: then only references
    of the same class count, and a query without one has no row. ``distance`` is squared. Null vectors are left out.
    """
    keep = ["id", "vector"] + ([by] if by else [])
    queries, refs = (d.select(*keep).where("id is not null and vector is not null") for d in (queries, refs))
    total, size = refs.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    blocks = max(1, -(-total // BLOCK_ROWS))
    kinds = queries.schema["id"].dataType.simpleString(), refs.schema["id"].dataType.simpleString()
    schema = f"query_id {kinds[0]}, ref_id {kinds[1]}, distance double"
    if blocks == 1:
        found = queries.mapInPandas(_search(refs.toPandas(), k, by), schema)
    else:
        found = _grid(queries, refs, k, by, schema, min(WIDER, max(1, 768 // max(1, size))))
    if k == 1:  # combined before the shuffle
        best = found.groupBy("query_id").agg(F.min(F.struct("distance", "ref_id")).alias("b"))
        return best.select("query_id", "b.ref_id", "b.distance", F.lit(1).alias("rank"))
    w = Window.partitionBy("query_id").orderBy("distance", "ref_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _grid(queries: DataFrame, refs: DataFrame, k: int, by: str | None, schema: str, wider: int = 1) -> DataFrame:
    """Every block of queries against every block of references, of its own class only, one bounded task each.

    Blocks hold up to ``wider`` times ``BLOCK_ROWS`` vectors where that leaves ``GRID_TASKS`` tasks.
    """
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    keys = [by] if by else []
    rows = lambda d, n: d.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    sizes = rows(queries, "_nq").join(rows(refs, "_nr"), keys) if by else rows(queries, "_nq").crossJoin(rows(refs, "_nr"))
    few = sizes.limit(MAX_CLASSES + 1).collect()
    tasks = lambda m: sum(-(-r["_nq"] // (m * BLOCK_ROWS)) * -(-r["_nr"] // (m * BLOCK_ROWS)) for r in few)
    block = BLOCK_ROWS * max(m for m in range(1, wider + 1) if m == 1 or tasks(m) >= GRID_TASKS)
    sizes = F.broadcast(queries.sparkSession.createDataFrame(few, sizes.schema)) if len(few) <= MAX_CLASSES else sizes  # checked
    sizes = sizes.withColumns({n: F.ceil(F.col(n) / F.lit(float(block))).cast("bigint") for n in ("_nq", "_nr")})
    cell = lambda d, n: F.pmod(F.xxhash64("id"), F.col(n))
    sized = lambda d: d.join(sizes, keys) if by else d.crossJoin(sizes)  # noqa: E731 - one row without classes
    asked = sized(queries).withColumn("_q", cell(queries, "_nq")).withColumn("_r", upto(F.col("_nr"))).drop("_nq", "_nr")
    known = sized(refs).withColumn("_r", cell(refs, "_nr")).withColumn("_q", upto(F.col("_nq"))).drop("_nq", "_nr")

    def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = list(_search(r, k, by)(iter([q]))) if len(q) and len(r) else []
        return pd.concat(out) if out else pd.DataFrame({"query_id": q["id"][:0], "ref_id": r["id"][:0], "distance": np.zeros(0)})

    at = [*keys, "_q", "_r"]
    n = min(MOST_PARTITIONS, SPREAD * tasks(block // BLOCK_ROWS))
    asked, known = asked.repartition(n, *at), known.repartition(n, *at)
    return asked.groupBy(*at).cogroup(known.groupBy(*at)).applyInPandas(run, schema)


def _search(table: pd.DataFrame, k: int, by: str | None):
    parts = {c: (p["id"].to_numpy(), np.stack(p["vector"].to_numpy()).astype(np.float64)) for c, p in (table.groupby(by) if by else [(0, table)]) if len(p)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c, own in b.groupby(by) if by else [(0, b)]:
                if c not in parts or not len(own):
                    continue
                ids, refs = parts[c]
                q = np.stack(own["vector"].to_numpy()).astype(np.float64)
                if k == 1 and (one := _closest(q, ids, refs)) is not None:
                    yield pd.DataFrame({"query_id": own["id"].to_numpy(), "ref_id": one[0], "distance": one[1]})
                    continue
                squares = (refs * refs).sum(axis=1)
                step = max(1, min(512, 4_000_000 // len(ids)))  # the matrix of a step stays at 32 MB
                for begin in range(0, len(q), step):
                    block = q[begin : begin + step]
                    rough = squares - 2 * block @ refs.T
                    some = min(len(ids), k + 16)  # margin for rounding and ties of the matrix form
                    near = np.argpartition(rough, some - 1, axis=1)[:, :some]
                    values = np.sort(np.take_along_axis(rough, near, axis=1), axis=1)
                    kth = values[:, min(k, some) - 1]
                    close = 1e-9 * (1 + np.abs(kth) + (block * block).sum(axis=1))
                    exact = ((refs[near] - block[:, None, :]) ** 2).sum(axis=2)
                    order = np.lexsort((ids[near], exact), axis=1)[:, :k]
                    rows = np.arange(len(block))[:, None]
                    found, away = ids[near][rows, order], exact[rows, order]
                    if some < len(ids):
                        for i in np.flatnonzero(values[:, -1] - kth <= close):  # ties beyond the margin: these rows alone
                            tied = np.flatnonzero(rough[i] <= kth[i] + close[i])
                            d = np.concatenate([((refs[at] - block[i]) ** 2).sum(axis=1) for at in np.array_split(tied, len(tied) // 4096 + 1)])
                            first = np.lexsort((ids[tied], d))[:k]
                            found[i], away[i] = ids[tied][first], d[first]
                    yield pd.DataFrame({"query_id": np.repeat(own["id"].to_numpy()[begin : begin + step], found.shape[1]), "ref_id": found.ravel(), "distance": away.ravel()})

    return run


def _closest(q: np.ndarray, ids: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(ids, squared distances) of each query's nearest reference, ties by the smaller id; None where single floats can't tell.

    Tiles of |r|^2 - 2qr are taken in single precision around the references' mean. With u = 2^-24, d dimensions and |r| at most 1
    such a value is off by at most (d + 8) u (1 + 2|q|), so the nearest is among those within twice that of the least.
    """
    middle = refs.mean(axis=0)
    r, p = refs - middle, q - middle
    with np.errstate(over="ignore", invalid="ignore"):
        scale = np.sqrt((r * r).sum(axis=1).max())
        if not (1e-100 < scale < 1e100 and np.sqrt((p * p).sum(axis=1)).max() < 1e3 * scale) or scale < 1e-6 * np.abs(middle).max():
            return None  # not finite, all alike, or too far from the queries
    r, p = r / scale, p / scale
    margin = (2 * (r.shape[1] + 8) * 2.0**-24 * (1 + 2 * np.sqrt((p * p).sum(axis=1)))).astype(np.float32)
    left = np.hstack([-2 * p, np.ones((len(p), 1))]).astype(np.float32)
    right = np.hstack([r, (r * r).sum(axis=1, keepdims=True)]).astype(np.float32)
    tiles = [np.ascontiguousarray(right[j : j + TILE[1]].T) for j in range(0, len(right), TILE[1])]
    del r, p, right
    found, away = np.empty(len(q), dtype=ids.dtype), np.full(len(q), np.inf)
    space = np.empty(TILE[0] * TILE[1], dtype=np.float32)  # the same memory for every tile
    for i in range(0, len(q), TILE[0]):
        a, wide = left[i : i + TILE[0]], margin[i : i + TILE[0]]
        least = np.full(len(a), np.inf, dtype=np.float32)
        for j, b in enumerate(tiles):
            rough = np.matmul(a, b, out=space[: len(a) * b.shape[1]].reshape(len(a), -1))
            low = rough.min(axis=1)
            rows = np.flatnonzero(low <= least + wide)
            least = np.minimum(least, low)
            x, y = np.nonzero(rough[rows] <= (least + wide)[rows, None])
            for at in range(0, len(x), 65_536):
                m, n = i + rows[x[at : at + 65_536]], j * TILE[1] + y[at : at + 65_536]
                d = ((refs[n] - q[m]) ** 2).sum(axis=1)
                order = np.lexsort((ids[n], d, m))
                first = order[np.r_[True, m[order][1:] != m[order][:-1]]]
                m, n, d = m[first], n[first], d[first]
                better = d < away[m]
                same = np.flatnonzero(d == away[m])
                better[same] = ids[n[same]] < found[m[same]]
                found[m[better]], away[m[better]] = ids[n[better]], d[better]
    return found, away


def _distinct(d: DataFrame, by: str | None, *more: Column) -> DataFrame:
    """One row per vector and class, with its smallest id, written."""
    keys = [by] if by else []
    return written(d.where("id is not null and vector is not null").groupBy(*keys, "vector").agg(F.min("id").alias("id"), *more))


def vote_histogram(voters: DataFrame, candidates: DataFrame, by: str | None = None) -> DataFrame:
    """(cand_id, votes): each voter votes for its nearest candidate, of its class if ``by`` is given; candidates without votes have 0.

    Equal vectors are searched once: of equal candidates only the smallest id gets votes, and equal voters vote alike.
    """
    known, asked = _distinct(candidates, by), _distinct(voters, by, F.count(F.lit(1)).alias("n"))
    rows, ids = voters.where("id is not null and vector is not null").agg(F.count(F.lit(1)), F.countDistinct("id")).first()
    if rows == ids:
        found = nearest(asked, known, 1, by).join(asked.select(F.col("id").alias("query_id"), "n"), "query_id")
    else:  # an id votes once
        found = nearest(voters, known, 1, by).withColumn("n", F.lit(1))
    given = found.groupBy(F.col("ref_id").alias("cand_id")).agg(F.sum("n").alias("votes"))
    every = candidates.select(F.col("id").alias("cand_id"))
    return every.join(given, "cand_id", "left").withColumn("votes", F.coalesce("votes", F.lit(0)).cast("bigint"))


def lost_votes(voters: DataFrame, candidates: DataFrame, by: str) -> DataFrame:
    """(class, votes) of voters whose class has no candidate."""
    have = candidates.select(by).distinct()
    return voters.join(have, by, "left_anti").groupBy(by).agg(F.count(F.lit(1)).alias("votes"))


def recall_between(one: DataFrame, other: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): share of the neighbours in ``one`` that are neighbours in ``other`` too."""
    own = one.groupBy("query_id").agg(F.collect_set("ref_id").alias("a"))
    others = other.groupBy("query_id").agg(F.collect_set("ref_id").alias("b"))
    return own.join(others, "query_id").select("query_id", (F.size(F.array_intersect("a", "b")) / float(k)).alias("recall"))
