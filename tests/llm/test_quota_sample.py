import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from skewloom.llm import quota_sample as module
from skewloom.llm.common import plain
from skewloom.llm.quota_sample import goals, labelled_rows, quota_sample, reservoirs, sample_misses, shortfalls, target_table

ATTRS = ["size", "kind", "words"]


def pool(spark, rows):
    return spark.createDataFrame(rows, "shard int, row_id bigint, size string, kind string, words int, text string, stratum string, id string")


def targets(spark, rows):
    return target_table(spark.createDataFrame(rows, "shard int, attr string, category string, share double, k int, min_rows int"), "shard")


def make(spark, n=600, seed=2):
    draw = random.Random(seed)
    rows = [(0, i, draw.choice(["Small", "small ", "LARGE"]), draw.choice(["x", "y", "y", "y"]), draw.choice([40, 60, 100]), "t", "clash", "clash") for i in range(n)]
    return rows, labelled_rows(pool(spark, rows), "shard", "row_id", "text", ATTRS, "words")


TARGET = [(0, "size", "small", 0.5, 100, 0), (0, "size", "Large", 0.5, 100, 0), (0, "kind", "X", 0.4, 100, 0), (0, "kind", "y", 0.6, 100, 0), (0, "words", "50", 0.5, 100, 3), (0, "words", "100", 0.5, 100, 0)]


def test_sample_meets_all_margins(spark):
    _, rows = make(spark)
    got = quota_sample(rows, targets(spark, TARGET), ATTRS).collect()
    assert len(got) == len({r["id"] for r in got}) == 100
    for attr, want in (("size", {"small": 50, "large": 50}), ("kind", {"x": 40, "y": 60}), ("words", {"50": 50, "100": 50})):
        have = Counter(r[attr] for r in got)
        assert all(abs(have[c] - n) <= 3 for c, n in want.items()), have
    again = quota_sample(rows.repartition(5), targets(spark, TARGET), ATTRS).collect()
    assert sorted(r["id"] for r in again) == sorted(r["id"] for r in got)


def test_exhausted_categories_are_reported_exactly(spark):
    raw, rows = make(spark, 120)
    wish = [(0, "kind", "x", 0.9, 100, 0), (0, "kind", "y", 0.1, 100, 0), (0, "kind", "z", 0.0, 100, 2), (0, "size", "Large", 0.0, 100, 5), (1, "kind", "x", 0.5, 10, 0)]
    got = {(r["stratum"], r["category"]): r["available"] for r in shortfalls(rows, targets(spark, wish), ATTRS).collect()}
    x = sum(r[3] == "x" for r in raw)
    assert got == {(0, "x"): x, (0, "z"): 0, (1, "x"): 0}
    got = quota_sample(rows, targets(spark, wish), ATTRS)
    assert got.count() == 100  # filled up from what is left


def test_repeated_rows_count_once_and_blanks_do_not(spark):
    rows = [(0, 1, "a", "x", 50, "t", "", "")] * 5 + [(0, 2, "A!", "x", 50, " \n", "", ""), (0, 3, "a", None, None, "t", "", ""), (0, None, "a", "x", 50, "t", "", ""), (0, 4, "a", "x", 50, None, "", "")]
    d = labelled_rows(pool(spark, rows), "shard", "row_id", "text", ATTRS, "words")
    got = {r["category"]: r["available"] for r in shortfalls(d, targets(spark, [(0, "size", "a", 0.5, 10, 0), (0, "kind", "x", 0.1, 10, 2)]), ATTRS).collect()}
    assert got == {"a": 2, "x": 1}
    sample = quota_sample(d, targets(spark, [(0, "size", "a", 1.0, 10, 0)]), ATTRS).collect()
    assert [r["id"] for r in sample] == [1]


def test_reservoirs_smaller_than_the_rows_stay_exact(spark):
    rows = [(0, i, "a", "x", 50, "t" * 20_000 if i == 0 else "t", "", "") for i in range(1000)]
    d = labelled_rows(pool(spark, rows).repartition(9), "shard", "row_id", "text", ATTRS, "words")
    assert shortfalls(d, targets(spark, [(0, "size", "a", 1.0, 7, 0), (0, "kind", "x", 0.5, 7, 0)]), ATTRS).count() == 0
    assert quota_sample(d, targets(spark, [(0, "size", "a", 1.0, 7, 0)]), ATTRS).count() == 7


def test_empty_tables(spark):
    none = labelled_rows(pool(spark, []), "shard", "row_id", "text", ATTRS, "words")
    t = targets(spark, TARGET)
    assert shortfalls(none, t, ATTRS).count() == len(TARGET)
    assert quota_sample(none, t, ATTRS).count() == 0
    _, rows = make(spark, 20)
    assert shortfalls(rows, targets(spark, []), ATTRS).count() == 0
    assert quota_sample(rows, targets(spark, []), ATTRS).count() == 0
    assert plain is not None


def test_minimums_hold_beside_an_unreachable_one(spark):
    draw = random.Random(5)
    rows = [(0, i, draw.choice(["a", "b", "c", "d"]), draw.choices(["x", "y", "rare"], [30, 60, 6])[0], draw.choice([50, 100, 150, 200]), "t", "", "") for i in range(900)]
    d = labelled_rows(pool(spark, rows), "shard", "row_id", "text", ATTRS, "words")
    wish = [(0, "kind", "x", 0.5, 60, 0), (0, "kind", "y", 0.49, 60, 5000), (0, "kind", "rare", 0.01, 60, 7), *((0, "size", c, 0.25, 60, 3) for c in "abcd"), *((0, "words", str(c), 0.25, 60, 0) for c in (50, 100, 150, 200))]
    t = targets(spark, wish)
    sample = quota_sample(d, t, ATTRS)
    have = Counter(r["kind"] for r in sample.collect())
    assert have == {"rare": 7, "y": 53}
    misses = {r["category"]: (r["need"], r["drawn"]) for r in sample_misses(sample, t, ATTRS).where("attr = 'kind'").collect()}
    assert misses == {"x": (30.0, 0), "y": (5000.0, 53)}


def test_minimums_come_first_and_shares_divide_the_rest():
    reserved, goal = goals(np.array([50.0, 50.0, 0.0]), np.array([0.0, 80.0, 4.0]), np.array([90, 70, 90]), 100)
    assert reserved.tolist() == [0, 70, 4] and np.allclose(goal, [26, 70, 4])
    reserved, _ = goals(np.array([5.0, 5.0, 0.0]), np.array([40.0, 90.0, 2.0]), np.array([99, 99, 99]), 10)
    assert reserved.tolist() == [4, 4, 2]


def test_rows_with_missing_labels_fill_exhausted_categories_and_k(spark):
    rows = [(0, i, "a" if i < 3 else "b", "x" if i % 2 else "y", 50, "t", "", "") for i in range(40)]
    rows += [(0, 100, "a", None, 50, "t", "", ""), (0, 101, "a", "x", None, "t", "", ""), (0, 101, "a", None, None, "t", "", ""), (0, 102, None, None, None, "t", "", ""), (0, 103, "a", None, 50, "t", "", ""), (0, 103, "a", "y", 50, "t", "", "")]
    d = labelled_rows(pool(spark, rows), "shard", "row_id", "text", ATTRS, "words")
    wish = [(0, "size", "a", 0.5, 20, 0), (0, "size", "b", 0.5, 20, 0), (0, "kind", "x", 0.5, 20, 0), (0, "kind", "y", 0.5, 20, 0)]
    got = {r["id"]: r for r in quota_sample(d, targets(spark, wish), ATTRS, incomplete=True).collect()}
    assert len(got) == 20 and {0, 1, 2, 100, 101, 103} <= set(got) and 102 not in got
    assert got[100]["kind"] is None and got[101]["kind"] == "x"
    every = quota_sample(d, targets(spark, [(0, "size", "a", 1.0, 60, 0)]), ATTRS, incomplete=True).collect()
    assert len(every) == 44
    assert {r["id"] for r in quota_sample(d, targets(spark, wish), ATTRS).collect()} >= {0, 1, 2, 103}


def test_every_miss_has_a_reason(spark):
    draw = random.Random(8)
    rows = [(0, i, "a" if i < 4 else draw.choice("bc"), "x" if i % 2 else "y", 50 if i % 2 else 100, "t", "", "") for i in range(400)]
    d = labelled_rows(pool(spark, rows), "shard", "row_id", "text", ATTRS, "words")
    supply = targets(spark, [(0, "size", "a", 0.2, 40, 0), (0, "size", "b", 0.4, 40, 0), (0, "size", "c", 0.4, 40, 0)])
    got = {(r["category"], r["available"], r["reason"]) for r in sample_misses(quota_sample(d, supply, ATTRS), supply, ATTRS, d).collect()}
    assert got == {("a", 4, "supply")}
    minimums = targets(spark, [(0, "size", "b", 0.5, 40, 30), (0, "size", "c", 0.5, 40, 30)])
    assert {r["reason"] for r in sample_misses(quota_sample(d, minimums, ATTRS), minimums, ATTRS, d).collect()} == {"minimums"}
    shares = targets(spark, [(0, "size", "b", 0.9, 40, 0), (0, "size", "c", 0.1, 40, 30)])
    assert {(r["category"], r["reason"]) for r in sample_misses(quota_sample(d, shares, ATTRS), shares, ATTRS, d).collect()} == {("b", "shares")}
    # Every x has 50 words and every y 100, so these two attributes cannot both be met.
    margins = targets(spark, [(0, "kind", "x", 0.9, 40, 0), (0, "kind", "y", 0.1, 40, 0), (0, "words", "50", 0.1, 40, 0), (0, "words", "100", 0.9, 40, 0)])
    got = {r["reason"] for r in sample_misses(quota_sample(d, margins, ATTRS), margins, ATTRS, d).collect()}
    assert got == {"margins"}


def test_labels_without_a_target_share_a_cell_and_keep_their_names(spark, monkeypatch):
    rows = [(0, i, f"odd {i}", "x" if i % 3 else "y", 50, "t", "", "") for i in range(300)] + [(7, 900, "a", "x", 50, "t", "", "")]
    d = labelled_rows(pool(spark, rows), "shard", "row_id", "text", ATTRS, "words")
    wish = targets(spark, [(0, "kind", "x", 0.5, 30, 0), (0, "kind", "y", 0.5, 30, 0)])
    got = {r["id"]: (r["size"], r["kind"]) for r in quota_sample(d, wish, ATTRS).collect()}
    assert len(got) == 30 and Counter(k for _, k in got.values()) == {"x": 15, "y": 15}
    assert all(size == f"odd{i}" for i, (size, _) in got.items())
    monkeypatch.setattr(module, "MAX_TARGETS", 0)
    assert {r["id"] for r in quota_sample(d, wish, ATTRS).collect()} == set(got)


def test_cut_reservoirs_equal_a_full_sort(spark, monkeypatch):
    draw = random.Random(4)
    rows = [(i % 2, draw.randrange(2000), draw.choice("ab"), draw.choice(["x", "y", None]), 50, "t", "", "") for i in range(5000)]
    d = labelled_rows(pool(spark, rows).repartition(5), "shard", "row_id", "text", ATTRS, "words")
    monkeypatch.setattr(module, "BUFFER_ROWS", 300)
    got = {}
    for r in reservoirs(d, ATTRS, 20, incomplete=True).collect():
        got.setdefault((r["stratum"], r["attr"], r["label"]), set()).add((r["draw"], r["id"]))
    want = {}
    hashed = {r["id"]: r["h"] for r in spark.range(2000).select("id", F.xxhash64(F.lit(0), F.col("id")).alias("h")).collect()}
    for shard, i, size, kind, words, *_ in rows:
        for key in ((shard, "size", size), (shard, "kind", kind), (shard, "words", str(words)), (shard, module.CELL, "\x1f".join([size, kind or module.MISSING, str(words)]))):
            if key[2] is not None:
                want.setdefault(key, set()).add((hashed[i], i))
    assert got == {k: set(sorted(v)[:20]) for k, v in want.items()}
