import random
from collections import Counter

import pytest

from skewloom.llm.splits import components, group_edges, grouped_split, reference_edges

WEIGHTS = {"train": 0.7, "validation": 0.15, "test": 0.15}


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def frame(spark, edges):
    return spark.createDataFrame(edges, "a bigint, b bigint")


def test_components_match_union_find(spark):
    draw = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)]  # a path
    edges += [(100, 100 + i) for i in range(1, 60)]  # a star
    edges += [(200 + draw.randrange(80), 200 + draw.randrange(80)) for _ in range(70)]
    draw.shuffle(edges)
    got = {r["node"]: r["component"] for r in components(frame(spark, edges)).collect()}
    want = union_find([e for e in edges if e[0] != e[1]])
    assert got == want


def test_hot_nodes_take_the_other_join(spark):
    edges = [(0, i) for i in range(1, 50)] + [(1000 + i, 1001 + i) for i in range(5)]
    got = {r["node"]: r["component"] for r in components(frame(spark, edges), hot_rows=5).collect()}
    assert got == union_find(edges)


def test_nulls_loops_repeats_and_empty(spark):
    edges = [(1, 2), (1, 2), (2, 1), (3, 3), (None, 4), (5, None)]
    got = sorted(tuple(r) for r in components(frame(spark, edges)).collect())
    assert got == [(1, 1), (2, 1)]
    assert components(frame(spark, [])).count() == 0


def test_not_stable_in_time_is_an_error(spark):
    with pytest.raises(RuntimeError):
        components(frame(spark, [(i, i + 1) for i in range(30)]), max_rounds=1)


def test_group_edges_compare_plainly_and_skip_nulls(spark):
    rows = [(1, "A b", 5), (2, "a-B!", 5), (3, "ab", 6), (4, None, 5), (5, "AB", None), (6, "ab", 5), (6, "ab", 5), (None, "ab", 5)]
    df = spark.createDataFrame(rows, "a bigint, b string, v int")  # names that clash with the edges' own
    got = sorted(tuple(r) for r in group_edges(df, "a", ["b", "v"]).collect())
    assert got == [(2, 1), (6, 1)]


def test_separators_in_values_do_not_merge_groups(spark):
    df = spark.createDataFrame([(1, "x", "y"), (2, "xy", "")], "i bigint, p string, q string")
    assert group_edges(df, "i", ["p", "q"]).count() == 0


def test_reference_edges_need_an_existing_parent(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 99), (4, 4), (2, 1)], "row_id bigint, parent bigint")
    assert [tuple(r) for r in reference_edges(df, "row_id", "parent").collect()] == [(2, 1)]


def test_split_keeps_families_and_proportions(spark):
    ids = [(i,) for i in range(3000)] + [(None,), (7,)]
    df = spark.createDataFrame(ids, "row_id bigint")
    edges = frame(spark, [(i, i + 1) for i in range(0, 3000, 3)])
    rows = grouped_split(df, "row_id", edges, WEIGHTS).collect()
    assert len(rows) == 3000
    of = {r["row_id"]: r["split"] for r in rows}
    assert all(of[i] == of[i + 1] for i in range(0, 3000, 3))
    share = {s: n / 3000 for s, n in Counter(of.values()).items()}
    assert abs(share["train"] - 0.7) < 0.04 and abs(share["test"] - 0.15) < 0.03
    again = {r["row_id"]: r["split"] for r in grouped_split(df.repartition(7), "row_id", edges, WEIGHTS).collect()}
    assert again == of


def test_dropping_a_split_moves_only_its_families(spark):
    df = spark.createDataFrame([(i,) for i in range(500)], "row_id bigint")
    edges = frame(spark, [])
    three = {r["row_id"]: r["split"] for r in grouped_split(df, "row_id", edges, WEIGHTS).collect()}
    two = {r["row_id"]: r["split"] for r in grouped_split(df, "row_id", edges, {k: WEIGHTS[k] for k in ("train", "test")}).collect()}
    assert all(two[i] == s for i, s in three.items() if s != "validation")
