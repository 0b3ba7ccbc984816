import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from skewloom.llm import consensus as module
from skewloom.llm.consensus import consensus, latest_votes, match_options

CLASSES = [10, 11, 12, 13]


def votes_of(items, annotators, seed=1):
    """Planted truth; annotators: name -> accuracy or 'always the first class'."""
    draw = random.Random(seed)
    truth = {i: draw.choice(CLASSES) for i in range(items)}
    rows = []
    for i, right in truth.items():
        for name, accuracy in annotators.items():
            if draw.random() < 0.8:
                wrong = draw.choice([c for c in CLASSES if c != right])
                said = CLASSES[0] if accuracy == "first" else right if draw.random() < accuracy else wrong
                rows.append((i, name, "attr", said))
    return truth, rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "item bigint, annotator string, attr string, option bigint")


def test_recovers_truth_and_reliability_better_than_the_majority(spark):
    crowd = {"good1": 0.9, "good2": 0.9, "weak1": 0.4, "weak2": 0.4, "bad1": 0.1, "bad2": 0.1, "spam": "first"}
    truth, rows = votes_of(800, crowd)
    items, reliability = consensus(frame(spark, rows))
    got = {r["item"]: r["option"] for r in items.collect()}
    tally = {}
    for i, _, _, o in rows:
        tally.setdefault(i, []).append(o)
    majority = {i: max(sorted(set(v)), key=v.count) for i, v in tally.items()}
    right = sum(got[i] == truth[i] for i in got) / len(got)
    plain = sum(majority[i] == truth[i] for i in majority) / len(majority)
    assert right > plain + 0.05 and right > 0.85
    rel = {r["annotator"]: r["reliability"] for r in reliability.collect()}
    assert rel["good1"] > 0.8 and rel["good2"] > 0.8 and rel["bad1"] < 0.3 and 0.2 < rel["weak1"] < 0.6


def test_agreement_counts_and_extra_edges(spark):
    rows = [(1, "a", "x", 10), (1, "b", "x", 11), (1, "b", "x", 11), (2, "a", "x", 10), (2, "b", "x", 10), (2, "c", "x", 11)]
    extra = [(1, "own", "x", 10), (3, "own", "x", 10)]
    items, reliability = consensus(frame(spark, rows), extra=frame(spark, extra))
    got = {r["item"]: r for r in items.collect()}
    assert set(got) == {1, 2}  # item 3 has no vote
    assert got[1]["option"] == 10 and got[1]["annotators"] == 2 and got[1]["options"] == 2
    assert abs(got[2]["agreement"] - 2 / 3) < 1e-9
    assert {r["annotator"] for r in reliability.collect()} == {"a", "b", "c", "own"}


def test_order_and_partitioning_do_not_matter(spark):
    _, rows = votes_of(100, {"a": 0.9, "b": 0.7, "c": 0.5})
    one = sorted(tuple(r)[:3] for r in consensus(frame(spark, rows))[0].collect())
    two = sorted(tuple(r)[:3] for r in consensus(frame(spark, rows[::-1] + rows).repartition(6))[0].collect())
    assert one == two


def test_empty_votes(spark):
    items, reliability = consensus(frame(spark, []))
    assert items.count() == 0 and reliability.count() == 0


def test_latest_annotation_replaces_and_options_compare_plainly(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    rows = [
        (1, "a", "Cell Biology", t(1), 1, "clash"), (1, "a", None, t(2), 2, "clash"),  # withdrawn
        (1, "b", "cell-biology!", t(1), 3, None), (2, "a", "Poetry", t(1), 4, ""), (2, "b", "ECOLOGY", None, 5, ""),
        (None, "a", "Ecology", t(1), 6, ""), (3, None, "Ecology", t(1), 7, ""), (2, "b", "ECOLOGY", None, 5, ""),
    ]
    df = spark.createDataFrame(rows, "row_id bigint, annotator string, map_area string, at timestamp, id bigint, item string")
    options = spark.createDataFrame([(7, "area", "Cell Biology"), (8, "area", "Ecology"), (9, "area", None)], "option_id bigint, attr string, option_value string")
    got = match_options(latest_votes(df, "row_id", "annotator", {"map_area": "area"}, ["at", "id"]), options)
    assert sorted((r["item"], r["annotator"], r["option"]) for r in got.collect()) == [(1, "b", 7), (2, "b", 8)]


def test_rates_as_a_joined_table_give_the_same(spark, monkeypatch):
    _, rows = votes_of(150, {"a": 0.9, "b": 0.8, "c": 0.4, "d": "first"})
    extra = frame(spark, [(i, "own", "attr", 10 + i % 4) for i in range(0, 150, 3)])
    key = lambda r: (r["attr"], r["item"], r["option"], round(r["confidence"], 6), round(r["agreement"], 6), r["annotators"], r["options"])
    one = consensus(frame(spark, rows), extra, max_rounds=4)
    monkeypatch.setattr(module, "MAX_RATES", 1)
    two = consensus(frame(spark, rows), extra, max_rounds=4)
    assert sorted(map(key, one[0].collect())) == sorted(map(key, two[0].collect()))
    rel = [{(r["attr"], r["annotator"]): (r["labels"], round(r["reliability"], 6)) for r in x[1].collect()} for x in (one, two)]
    assert rel[0] == rel[1]


def test_rounds_end_when_every_rate_is_still(spark, monkeypatch):
    _, rows = votes_of(300, {"good1": 0.9, "good2": 0.8, "weak1": 0.4, "weak2": 0.3, "spam": "first"})
    seen = []

    class Seen(module.Rates):
        def __init__(self, *how):
            super().__init__(*how)
            seen.append(self)

    with monkeypatch.context() as m:
        m.setattr(module, "Rates", Seen)
        consensus(frame(spark, rows))
    assert 2 < len(seen) < 30
    assert np.abs(seen[-1].hit - seen[-2].hit).max() < 2e-3 and np.abs(seen[-1].false - seen[-2].false).max() < 2e-3
    for most in (module.MAX_RATES, 1):
        monkeypatch.setattr(module, "MAX_RATES", most)
        with pytest.warns(RuntimeWarning, match="max_rounds = 2"):
            consensus(frame(spark, rows), max_rounds=2)


def test_an_annotator_of_all_items_and_an_item_of_many_annotators_are_split_in_the_join_path(spark, monkeypatch):
    _, rows = votes_of(120, {"all": 1.0, "b": 0.8, "c": 0.4}, seed=3)
    rows += [(500, f"n{k}", "attr", CLASSES[k % 3 == 0]) for k in range(200)]
    key = lambda r: (r["attr"], r["item"], r["option"], round(r["confidence"], 6), round(r["agreement"], 6), r["annotators"], r["options"])
    one = consensus(frame(spark, rows), max_rounds=3)
    hot = []
    real = module.join_unique

    def spied(left, right, keys, counts, hot_rows=50):
        hot.append((tuple(keys), counts.where(F.col("_n") > 50).count()))
        return real(left, right, keys, counts, hot_rows)

    monkeypatch.setattr(module, "MAX_RATES", 1)
    monkeypatch.setattr(module, "join_unique", spied)
    two = consensus(frame(spark, rows), max_rounds=3)
    assert sorted(map(key, one[0].collect())) == sorted(map(key, two[0].collect()))
    assert {k for k, n in hot if n} == {("attr", "annotator"), ("attr", "item")}
