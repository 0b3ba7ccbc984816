import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skewloom.operators.raking import marginals, rake, raked_select
from skewloom.operators.selection import largest_remainder, quota_select, selection_info, survivors_per_class, top_k


def planted(spark, n=1500, seed=1):
    """Candidates whose score favours one value of a and b; targets with another mix."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = draw.choice("xyz"), draw.choice("uv")
        rows.append((i, draw.random() + 0.1 * (a == "x") + 0.1 * (b == "u"), a, b, f"{a}|{b}"))
    goal = Counter((draw.choices("xyz", [1, 3, 6])[0], draw.choices("uv", [2, 3])[0]) for _ in range(2000))
    cand = spark.createDataFrame(rows, "cand_id bigint, score double, a string, b string, cell string")
    target = spark.createDataFrame([(f"{a}|{b}", c / 2000) for (a, b), c in goal.items()], "cell string, p double")
    labels = spark.createDataFrame([(a, b) for (a, b), c in goal.items() for _ in range(c)], "a string, b string")
    return rows, cand, target, labels, goal


K = 200


def test_strength_0_is_plain_top_k(spark):
    _, cand, target, _, _ = planted(spark)
    base = {r["cand_id"] for r in top_k(cand, K).collect()}
    got = quota_select(cand, target, 0.0, K).collect()
    assert {r["cand_id"] for r in got} == base and all(r["in_base"] for r in got)


def test_strength_1_meets_every_target_and_keeps_the_best_of_each_cell(spark):
    rows, cand, target, _, goal = planted(spark)
    got = quota_select(cand, target, 1.0, K).collect()
    assert len({r["cand_id"] for r in got}) == K
    have = Counter(r["cell"] for r in got)
    for (a, b), c in goal.items():
        assert abs(have[f"{a}|{b}"] / K - c / 2000) <= 1 / K + 1e-9
    for cell, n in have.items():
        best = sorted((r for r in rows if r[4] == cell), key=lambda r: (-r[1], r[0]))[:n]
        assert {r[0] for r in best} == {r["cand_id"] for r in got if r["cell"] == cell}


def test_water_filling_keeps_k_and_reports_the_shortfall(spark):
    rows = [(i, float(10 - i), "a" if i < 8 else "b") for i in range(10)]
    cand = spark.createDataFrame(rows, "cand_id bigint, score double, cell string")
    target = spark.createDataFrame([("b", 0.9), ("w", 0.1)], "cell string, p double")  # no candidate has w
    got = quota_select(cand, target, 1.0, 5)
    info = selection_info(got, 5).first()
    assert (info["chosen"], info["shortfall"]) == (5, 3)
    assert {r["cand_id"] for r in got.collect()} == {8, 9, 0, 1, 2} and info["moved"] == 2


def test_fewer_candidates_than_k_all_survive(spark):
    cand = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b")], "cand_id bigint, score double, cell string")
    target = spark.createDataFrame([("a", 1.0)], "cell string, p double")
    assert quota_select(cand, target, 0.5, 9).count() == 2
    assert quota_select(cand.limit(0), target, 0.5, 9).count() == 0


def test_runs_are_independent(spark):
    _, cand, target, _, _ = planted(spark, 400)
    runs = cand.withColumn("run", F.explode(F.array(F.lit(1), F.lit(2))))
    goal = target.withColumn("run", F.explode(F.array(F.lit(1), F.lit(2))))
    both = quota_select(runs, goal, 0.5, 50, ["run"]).collect()
    one = {r["cand_id"] for r in quota_select(cand, target, 0.5, 50).collect()}
    for k in (1, 2):
        assert {r["cand_id"] for r in both if r["run"] == k} == one


def test_ties_go_to_the_smaller_id(spark):
    cand = spark.createDataFrame([(i, float(s)) for i, s in enumerate([1, 5, 3, 5, -2])], "cand_id bigint, score double")
    assert [r["cand_id"] for r in top_k(cand, 3).orderBy("rank").collect()] == [1, 3, 2]


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 50), min_size=1, max_size=8), st.integers(0, 60))
def test_largest_remainder(spark, weights, total):
    df = spark.createDataFrame([(f"c{i}", float(w)) for i, w in enumerate(weights)], "cell string, w double")
    got = {r["cell"]: r["quota"] for r in largest_remainder(df, total, [], "cell").collect()}
    if sum(weights) == 0:
        assert set(got.values()) == {0}
    else:
        assert sum(got.values()) == total
        assert all(abs(got[f"c{i}"] - total * w / sum(weights)) < 1 for i, w in enumerate(weights))


def test_survivors_per_class(spark):
    df = spark.createDataFrame([(i, 100 + 7 * i) for i in range(49)], "class int, n bigint")
    assert sum(r["k"] for r in survivors_per_class(df, 2000).collect()) == 2000
    with pytest.raises(Exception, match="no survivor"):
        survivors_per_class(spark.createDataFrame([(1, 10_000), (2, 1)], "class int, n bigint"), 10).collect()


def test_raking_meets_the_marginals_and_grows_with_strength(spark):
    _, cand, _, labels, _ = planted(spark, 2500)
    goal = marginals(labels, ["a", "b"])
    want = {(r["attr"], r["value"]): r["p"] for r in goal.collect()}
    off = []
    for strength in (0.0, 0.5, 1.0):
        got = raked_select(cand, goal, ["a", "b"], strength, K).collect()
        assert len({r["cand_id"] for r in got}) == K
        off.append(max(abs(sum(r[a] == v for r in got) / K - p) for (a, v), p in want.items()))
    assert off[2] < 0.03 and off[0] > off[1] > off[2]


@pytest.mark.parametrize("strength", [0.5, 1.0])
@pytest.mark.parametrize("seed", range(3))
def test_caps_bind_and_still_k_rows_survive(spark, seed, strength):
    draw = random.Random(seed)
    n, k = draw.randint(8, 40), draw.randint(2, 7)
    cand = spark.createDataFrame([(i, draw.random(), draw.choice("xy"), draw.choice("uv")) for i in range(n)], "cand_id bigint, score double, a string, b string")
    goal = spark.createDataFrame([("a", "w", 0.6), ("a", "x", 0.4), ("b", "u", 0.9), ("b", "v", 0.1)], "attr string, value string, p double")
    got = raked_select(cand, goal, ["a", "b"], strength, k).collect()
    assert len({r["cand_id"] for r in got}) == min(k, n)


def test_rake_equals_plain_proportional_fitting_without_caps():
    base = np.array([0.4, 0.1, 0.3, 0.2])
    members = {"a": np.array(["x", "x", "y", "y"]), "b": np.array(["u", "v", "u", "v"])}
    goal = {"a": {"x": 0.3, "y": 0.7}, "b": {"u": 0.5, "v": 0.5}}
    w = rake(base, base, members, goal, 1.0, np.ones(4))
    v = base.copy()
    for _ in range(2000):
        for a, value in members.items():
            for name, p in goal[a].items():
                v[value == name] *= p / v[value == name].sum()
    assert np.allclose(w, v, atol=1e-5)
