"""Ranking over ranges, ties of neighbours, quantiles under outliers, blocks inside classes."""

import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from skewloom.operators import histograms, knn, selection
from skewloom.operators.histograms import exact_quantiles
from skewloom.operators.knn import nearest
from skewloom.operators.raking import marginals, raked_select
from skewloom.operators.selection import global_rank, quota_select, top_k
from skewloom.operators.splits import drawn


def rows(n, seed=1):
    draw = random.Random(seed)
    return [(i, float(draw.randint(0, 6)), draw.choice("xyz"), draw.choice("uv"), draw.choice([1, 2, None])) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "cand_id bigint, score double, a string, b string, run int").repartition(5)


def test_global_rank_equals_sorting_with_null_keys_and_ties(spark):
    data = rows(500)
    got = {r["cand_id"]: r["rank"] for r in global_rank(frame(spark, data), ["run"], [F.col("score").desc(), F.col("cand_id").asc()], parts=7).collect()}
    for run in (1, 2, None):
        own = sorted((r for r in data if r[4] == run), key=lambda r: (-r[1], r[0]))
        assert [got[r[0]] for r in own] == list(range(1, len(own) + 1))


def test_selection_over_ranges_equals_the_one_by_windows(spark, monkeypatch):
    data = [(*r[:4], r[4] or 3) for r in rows(400, 2)]
    cand = frame(spark, data).withColumn("cell", F.concat_ws("|", "a", "b"))
    goal = spark.createDataFrame([("x|u", 0.5), ("y|v", 0.4), ("none", 0.1)], "cell string, p double")
    ids = lambda d: sorted((r["run"], r["cand_id"], r["by_quota"], r["in_base"]) for r in d.collect())
    small = ids(quota_select(cand, goal, 0.7, 40, ["run"])), ids(quota_select(cand, goal, 0.7, 60)), sorted((r["cand_id"], r["rank"]) for r in top_k(cand, 50).collect())
    raked = ids(raked_select(cand, marginals(cand, ["a", "b"]), ["a", "b"], 1.0, 50))
    monkeypatch.setattr(selection, "WINDOW_LIMIT", 0)
    assert small == (ids(quota_select(cand, goal, 0.7, 40, ["run"])), ids(quota_select(cand, goal, 0.7, 60)), sorted((r["cand_id"], r["rank"]) for r in top_k(cand, 50).collect()))
    assert raked == ids(raked_select(cand, marginals(cand, ["a", "b"]), ["a", "b"], 1.0, 50))
    sizes = spark.createDataFrame([(1, 10), (2, 25), (3, 0)], "run int, k bigint")
    got = quota_select(cand, goal, 0.7, sizes, ["run"]).groupBy("run").count().collect()
    assert {r["run"]: r["count"] for r in got} == {1: 10, 2: 25}
    assert quota_select(cand.limit(0), goal, 0.7, 5000).count() == 0 and quota_select(cand, goal, 0.7, 5000).count() == 400


@pytest.mark.parametrize("k", [10_000, 100_000])
def test_no_task_gets_all_candidates_for_a_large_k(spark, k):
    cand = spark.range(300_000).select(F.col("id").alias("cand_id"), (F.col("id") % 1000).cast("double").alias("score"), (F.col("id") % 5).cast("string").alias("cell"))
    goal = spark.createDataFrame([("1", 0.5), ("2", 0.5)], "cell string, p double")
    d = quota_select(cand, goal, 0.5, k)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert d.count() == k
    # What goes to a single task are sums over ranges and cells, never rows: no candidate id under such an exchange.
    for part in re.split(r"\n(?=[^\n]*Exchange SinglePartition)", plan)[1:]:
        depth = re.match(r"[^A-Z*(]*", part)[0]
        below = [line for line in part.split("\n")[1:] if len(re.match(r"[^A-Z*(]*", line)[0]) > len(depth)]
        assert below and "Aggregate" in below[0]


def test_own_marginals_per_class_and_a_k_of_each(spark):
    data = [(i, random.Random(i).random(), "xyz"[i % 3], "uv"[i % 2], 1 + i % 2) for i in range(600)]
    cand = frame(spark, data)
    every = spark.createDataFrame([("a", "x", 0.6), ("a", "y", 0.3), ("a", "z", 0.1)], "attr string, value string, p double")
    own = spark.createDataFrame([(2, "a", "x", 0.1), (2, "a", "z", 0.9)], "run int, attr string, value string, p double")
    sizes = spark.createDataFrame([(1, 100), (2, 50)], "run int, k bigint")
    got = raked_select(cand, every, ["a"], 1.0, sizes, ["run"], own).groupBy("run", "a").count().collect()
    assert {(r["run"], r["a"]): r["count"] for r in got} == {(1, "x"): 60, (1, "y"): 30, (1, "z"): 10, (2, "x"): 5, (2, "z"): 45}


def vectors(spark, x, by=None):
    return spark.createDataFrame([(i, [float(v) for v in r], None if by is None else int(by[i])) for i, r in enumerate(x)], "id bigint, vector array<double>, g int")


def test_many_equal_references_need_little_memory():
    import pandas as pd

    refs = np.zeros((5000, 64))
    refs[4000:] = np.random.default_rng(1).normal(size=(1000, 64)) + 9
    table = pd.DataFrame({"id": np.arange(5000)[::-1].copy(), "vector": list(refs)})
    queries = pd.DataFrame({"id": np.arange(512), "vector": list(np.random.default_rng(2).normal(size=(512, 64)) * 1e-3)})
    search = knn._search(table, 5, None)
    tracemalloc.start()
    got = pd.concat(list(search(iter([queries]))))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 500e6 and len(got) == 512 * 5
    assert sorted(got[got["query_id"] == 7]["ref_id"]) == [1000, 1001, 1002, 1003, 1004]  # of equal ones the smallest ids


def test_a_grid_inside_classes_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 15)
    x = np.random.default_rng(3).integers(0, 4, (90, 3)).astype(float)
    g = np.where(np.arange(90) < 70, 0, 1 + np.arange(90) % 2)
    got = {(r["query_id"], r["rank"]): r["ref_id"] for r in nearest(vectors(spark, x[:40], g), vectors(spark, x, g), 4, by="g").collect()}
    for q in range(40):
        order = sorted((i for i in range(90) if g[i] == g[q]), key=lambda i: (((x[q] - x[i]) ** 2).sum(), i))[:4]
        assert [got[q, k + 1] for k in range(len(order))] == order


@pytest.mark.parametrize("most", [100_000, 20])
def test_quantiles_under_an_outlier(spark, monkeypatch, most):
    monkeypatch.setattr(histograms, "MOST_IN_CELL", most)
    draw = np.random.default_rng(5)
    x = np.r_[draw.normal(size=800), np.full(300, 0.25), 1e12, -3e11]
    df = spark.createDataFrame([(float(v), float(i % 3)) for i, v in enumerate(x)] + [(None, float("nan"))], "x double, y double")
    shares = [0.0, 0.1, 0.37, 0.5, 0.75, 1.0]
    got = exact_quantiles(df, ["x", "y"], shares)
    assert np.allclose(got["x"], np.quantile(x, shares), rtol=1e-12) and np.allclose(got["y"], np.quantile(np.arange(len(x)) % 3, shares))
    assert exact_quantiles(df.limit(0), ["x"], shares) == {"x": []}


def test_a_draw_is_exact_and_takes_all_of_a_small_table(spark):
    d = spark.range(3000).withColumnRenamed("id", "i")
    some = {r["i"] for r in drawn(d, F.col("i"), 100).collect()}
    more = {r["i"] for r in drawn(d.repartition(9), F.col("i"), 250).collect()}
    assert len(some) == 100 and len(more) == 250 and some < more
    assert drawn(d, F.col("i"), 5000).count() == 3000 and drawn(d.limit(0), F.col("i"), 5).count() == 0
