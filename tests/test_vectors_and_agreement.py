import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skewloom.functions.vector import layer_norm, norm, unit
from skewloom.operators import knn
from skewloom.operators.agreement import (
    cohen_kappa, confusion, corrected_marginal, jensen_shannon, macro_f1, mutual_information, neighbour_kappa, nonnegative_least_squares,
)
from skewloom.operators.knn import lost_votes, nearest, recall_between, vote_histogram


def vectors(spark, x, by=None):
    rows = [(i, [float(v) for v in row], None if by is None else int(by[i])) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, vector array<double>, g int")


def test_nearest_equals_brute_force_with_ties(spark):
    draw = np.random.default_rng(0)
    x = draw.integers(0, 3, (60, 4)).astype(float)  # many equal distances
    got = {(r["query_id"], r["rank"]): r["ref_id"] for r in nearest(vectors(spark, x[:25]), vectors(spark, x), 5).collect()}
    for q in range(25):
        order = sorted(range(60), key=lambda i: (((x[q] - x[i]) ** 2).sum(), i))[:5]
        assert [got[q, k + 1] for k in range(5)] == order


def test_blocks_in_a_grid_give_the_same(spark, monkeypatch):
    x = np.random.default_rng(1).normal(size=(70, 6))
    q, r = vectors(spark, x[:30], np.arange(30) % 2), vectors(spark, x, np.arange(70) % 2)
    one = sorted((a["query_id"], a["rank"], a["ref_id"]) for a in nearest(q, r, 3, by="g").collect())
    monkeypatch.setattr(knn, "BLOCK_ROWS", 20)
    assert sorted((a["query_id"], a["rank"], a["ref_id"]) for a in nearest(q, r, 3, by="g").collect()) == one


def test_class_votes(spark):
    voters = vectors(spark, [[0, 0], [1, 0], [5, 5]], [0, 1, 1])
    cands = vectors(spark, [[0, 0.1], [9, 9], [5, 4], [1, 0.2]], [1, 1, 1, 1])
    plain = {r["cand_id"]: r["votes"] for r in vote_histogram(voters, cands).collect()}
    grouped = {r["cand_id"]: r["votes"] for r in vote_histogram(voters, cands, by="g").collect()}
    assert plain == {0: 1, 1: 0, 2: 1, 3: 1} and grouped == {0: 0, 1: 0, 2: 1, 3: 1}
    assert [tuple(r) for r in lost_votes(voters, cands, "g").collect()] == [(0, 1)]


def test_nulls_and_empty_sides(spark):
    some = vectors(spark, [[0.0, 1.0]])
    none = some.limit(0)
    assert nearest(some, none, 2).count() == 0 and nearest(none, some, 2).count() == 0
    assert nearest(some.withColumn("vector", F.lit(None).cast("array<double>")), some, 2).count() == 0


def test_recall_of_equal_spaces_is_one(spark):
    v = vectors(spark, np.random.default_rng(2).normal(size=(20, 3)))
    n = nearest(v, v, 4)
    assert all(r["recall"] == 1.0 for r in recall_between(n, n, 4).collect())


def test_planted_visibility(spark):
    draw = np.random.default_rng(3)
    loud, quiet = draw.integers(0, 3, 300), draw.integers(0, 4, 300)
    x = draw.normal(size=(300, 8)) * 0.3
    x[np.arange(300), loud] += 5
    v = vectors(spark, x)
    lab = spark.createDataFrame([(i, a, str(l[i])) for a, l in (("loud", loud), ("absent", quiet)) for i in range(300)], "id bigint, attr string, value string")
    half = v.where("id < 150"), v.where("id >= 150")
    got = {r["attr"]: r["kappa"] for r in neighbour_kappa(nearest(half[1], half[0], 5), lab).collect()}
    assert got["loud"] > 0.9 and abs(got["absent"]) < 0.12


def long(spark, values):
    return spark.createDataFrame([("a", v) for v in values], "attr string, value string")


def jsd(p, q):
    names = sorted(set(p) | set(q))
    a, b = (np.array([s.count(n) for n in names]) / len(s) for s in (p, q))
    m = (a + b) / 2
    kl = lambda x: sum(v * math.log(v / w) for v, w in zip(x, m) if v)
    return math.sqrt((kl(a) + kl(b)) / 2)


def test_jensen_shannon(spark):
    p, q = ["x", "x", "y", "z"], ["x", "w"]
    assert jensen_shannon(long(spark, p + [None]), long(spark, q), ["attr"]).first()["jsd"] == pytest.approx(jsd(p, q))
    assert jensen_shannon(long(spark, p), long(spark, p), ["attr"]).first()["jsd"] == 0
    assert jensen_shannon(long(spark, ["x"]), long(spark, ["y"]), ["attr"]).first()["jsd"] == pytest.approx(math.sqrt(math.log(2)))
    assert jensen_shannon(long(spark, p), long(spark, [None]), ["attr"]).first()["jsd"] is None


def test_kappa_f1_confusion(spark):
    draw = random.Random(1)
    rows = [("t", draw.choice("ab"), draw.choice("abc")) for _ in range(60)] + [("t", None, "a"), ("one", "a", "a")]
    pairs = spark.createDataFrame(rows, "attr string, a string, b string")
    full = [(x, y) for t, x, y in rows if t == "t" and x]
    n = len(full)
    po = sum(x == y for x, y in full) / n
    pe = sum(sum(x == c for x, _ in full) * sum(y == c for _, y in full) for c in "abc") / n**2
    got = {r["attr"]: r["kappa"] for r in cohen_kappa(pairs, ["attr"]).collect()}
    assert got["t"] == pytest.approx((po - pe) / (1 - pe)) and got["one"] is None
    f1 = []
    for c in "ab":
        tp, t, p = sum(x == y == c for x, y in full), sum(x == c for x, _ in full), sum(y == c for _, y in full)
        f1.append(2 * tp / (t + p))
    row = {r["attr"]: r for r in macro_f1(pairs, ["attr"]).collect()}["t"]
    assert row["macro_f1"] == pytest.approx(np.mean(f1)) and row["accuracy"] == pytest.approx(po)
    classes = spark.createDataFrame([("t", "a"), ("t", "b")], "attr string, value string")
    cells = confusion(pairs, classes, ["attr"]).collect()
    assert len(cells) == 4 and all(abs(sum(r["p"] for r in cells if r["a"] == c) - 1) < 1e-9 for c in "ab")


def test_mutual_information(spark):
    rows = [(i, a, v) for i in range(40) for a, v in (("p", str(i % 2)), ("q", str(i % 2)), ("r", str(i // 20)), ("s", "c"))]
    got = {(r["attr_a"], r["attr_b"]): r["nmi"] for r in mutual_information(spark.createDataFrame(rows, "id bigint, attr string, value string")).collect()}
    assert got["p", "q"] == pytest.approx(1) and got["p", "r"] == pytest.approx(0, abs=1e-9) and got["s", "s"] == 1 and got["p", "s"] == 0


def test_least_squares_and_correction():
    draw = np.random.default_rng(0)
    a = draw.random((6, 4))
    x = np.array([0.0, 1.5, 0.0, 0.3])
    assert np.allclose(nonnegative_least_squares(a, a @ x), x, atol=1e-9)
    c = np.array([[0.9, 0.1], [0.2, 0.8]])
    assert np.allclose(corrected_marginal(c, c.T @ np.array([0.3, 0.7])), [0.3, 0.7])


def test_vector_functions(spark):
    d = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    got = d.select(norm(F.col("v")).alias("n"), unit(F.col("v")).alias("u"), layer_norm(F.col("v")).alias("l")).collect()
    assert got[0]["n"] == 5 and got[0]["u"] == [0.6, 0.8] and got[1]["u"] == [0, 0]
    assert np.allclose(got[0]["l"], [-1, 1], atol=1e-3)
