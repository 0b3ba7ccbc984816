"""Analyses against plain Python, loaders, sinks, annotators and the loop's roles."""

import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skewloom.functions import text as T
from skewloom.functions.labels import cyclic, encode_labels
from skewloom.operators.agreement import corrected_marginal
from skewloom.operators.analysis import blind_table, drift_summary, evaluate, group_kappa, length_null, resampled_floor, two_stage, vote_correction
from skewloom.operators.loop import Settings, classifier_annotator, grid, labelled, run_loop, service_annotator, sweep, target_cells, variations
from skewloom.operators.ml import load_model, predictor, save_model, text_classifier
from skewloom.operators.report import metric_columns
from skewloom.sources.connectors import hashed_embedding, in_vocabulary, map_batches, model_tag, parse_labels
from skewloom.sources.runlog import find_run_folders, two_methods
from skewloom.sources.sinks import read_settings, write_settings, write_split
from skewloom.sources.tables import class_conflicts, class_map, dataset_path, load_role
from skewloom.spec import PLAIN_BUDGETS, Dataset, Vocabulary

VOCABULARY = Vocabulary({"a": ["x", "y"], "b": ["u", "v", "w"]}, {"a": "y", "b": "w"})


def test_surface_features_by_hand(spark):
    text = "We show (in Fig. 2) that it may suggest 3.5% growth. The DNA-based model was quickly tested. CI 95. It's p < 0.05!"
    one = spark.createDataFrame([(text,), ("",), ("  ",)], "t string").select(*(c.alias(n) for n, c in T.features(F.col("t")).items())).collect()
    f = one[0]
    tokens = ["We", "show", "in", "Fig", "2", "that", "it", "may", "suggest", "3.5", "growth", "The", "DNA-based", "model", "was", "quickly", "tested", "CI", "95.", "It's", "p", "0.05"]
    assert f["mean_sentence_length"] == len(tokens) / 4 and f["numeric_rate"] == 4 / 22 and f["has_statistic"] == 1
    assert f["hedge_rate"] == 2 / 22 and f["first_person_rate"] == 1 / 22 and f["acronym_rate"] == 2 / 22 and f["passive_per_sentence"] == 1 / 4
    assert f["mean_word_length"] == pytest.approx(np.mean([len(t) for t in tokens if t[0].isalpha()])) and f["word_count"] == len(text.split())
    assert f["moving_ttr"] == len({t.lower() for t in tokens}) / 22
    for r in one[1:]:
        assert r["moving_ttr"] == 0 and r["mean_word_length"] == 0 and r["mean_sentence_length"] == 1 and r["word_count"] == 0
    long = spark.createDataFrame([(" ".join(f"w{'a' * (i % 60)}" for i in range(120)),)], "t string").select(T.features(F.col("t"))["moving_ttr"].alias("m")).first()["m"]
    words = [f"w{'a' * (i % 60)}" for i in range(120)]
    assert long == pytest.approx(np.mean([len(set(words[i : i + 50])) / 50 for i in range(0, 71, 5)]))


def test_kappa_inside_groups_skips_groups_without_references(spark):
    near = spark.createDataFrame([(1, 10), (2, 11)], "query_id bigint, ref_id bigint")
    labels = spark.createDataFrame([(i, "t", v) for i, v in ((1, "p"), (2, "q"), (3, "p"), (10, "p"), (11, "p"))], "id bigint, attr string, value string")
    members = spark.createDataFrame([(1, 0, True), (2, 0, True), (3, 9, True), (10, 0, False), (11, 0, False)], "id bigint, group int, is_query boolean")
    chance = (3 / 4) ** 2 + (1 / 4) ** 2
    assert group_kappa(near, labels, members).first()["kappa"] == pytest.approx((0.5 - chance) / (1 - chance))
    table = blind_table(spark.createDataFrame([("s", 0, 0.2), ("s", 1, 0.4), ("t", 0, 0.1), ("t", 1, 0.1)], "attr string, repeat int, kappa double")).collect()
    assert {r["attr"]: r["place"] for r in table} == {"t": 1, "s": 2}
    got = two_stage(spark.createDataFrame([("s", 0, 0.2), ("t", 0, 0.4), ("s", 1, 0.6), ("t", 1, None)], "attr string, repeat int, value double"), []).first()
    assert got["mean"] == pytest.approx(0.45) and got["n"] == 2 and got["sd"] == pytest.approx(np.std([0.3, 0.6], ddof=1))


def test_a_vote_for_the_right_label_corrects_and_a_blind_one_does_not(spark):
    draw = random.Random(1)
    cand = [(i, "good" if i % 4 == 0 else "bad", draw.choice("mn")) for i in range(400)]
    votes = spark.createDataFrame([(i, 5 if g == "good" else 0) for i, g, _ in cand], "id bigint, votes bigint")
    labels = spark.createDataFrame([(i, a, v) for i, g, m in cand for a, v in (("seen", g), ("blind", m))], "id bigint, attr string, value string")
    target = spark.createDataFrame([(1000 + i, a, v) for i in range(300) for a, v in (("seen", "good" if i % 10 else "bad"), ("blind", "m" if i % 2 else "n"))], "id bigint, attr string, value string")
    got = {(r["sigma"], r["attr"]): r for r in vote_correction(votes, labels, target, 100, 4, (0.0, 50.0)).collect()}
    assert got[0.0, "seen"]["correction"] > 0.6 > 0.3 > abs(got[50.0, "seen"]["correction"])
    assert got[0.0, "blind"]["correction"] is None and set(got) == {(s, a) for s in (0.0, 50.0) for a in ("seen", "blind")}


def test_evaluation_of_an_annotator(spark):
    draw = random.Random(2)
    true = [draw.choice("xxxy") for _ in range(400)]
    pred = [t if draw.random() < 0.8 else ("y" if t == "x" else "x") for t in true]
    pairs = spark.createDataFrame([(i, "a", t, p) for i, (t, p) in enumerate(zip(true, pred))] + [(900, "a", None, "x")], "id bigint, attr string, a string, b string")
    classes = spark.createDataFrame([("a", "x"), ("a", "y")], "attr string, value string")
    got = evaluate(pairs, classes).first()
    assert got["n"] == 400 and got["accuracy"] == pytest.approx(np.mean([t == p for t, p in zip(true, pred)]))
    assert got["marginal_jsd_corrected"] < got["marginal_jsd"] / 5 and 0 < got["marginal_jsd_floor"] < 0.05
    rows = np.array([[sum(t == a and p == b for t, p in zip(true, pred)) + 0.1 for b in "xy"] for a in "xy"])
    want = corrected_marginal(rows / rows.sum(axis=1, keepdims=True), np.array([pred.count("x"), pred.count("y")]) / 400)
    share = Counter(true)
    m = [(want[k] + share[c] / 400) / 2 for k, c in enumerate("xy")]
    jsd = math.sqrt(sum(want[k] * math.log(want[k] / m[k]) + share[c] / 400 * math.log(share[c] / 400 / m[k]) for k, c in enumerate("xy")) / 2)
    assert got["marginal_jsd_corrected"] == pytest.approx(jsd, abs=1e-6)
    one = spark.createDataFrame([(i, "a", "x") for i in range(9)], "id bigint, attr string, value string")
    assert resampled_floor(one).first()["floor"] == 0


def test_drift_pairs_runs_and_lengths_explain_what_they_explain(spark):
    long = spark.createDataFrame([("m", s, r, v) for s, r, v in ((0, 0, 0.1), (0, 3, 0.4), (1, 0, 0.2), (1, 3, 0.3), (2, 0, 0.9), (3, 3, None), (3, 0, 0.5))], "metric string, seed int, round int, value double")
    got = drift_summary(long, ["metric"], ["seed"], 3).first()
    assert got["n"] == 2 and got["change"] == pytest.approx(0.2) and got["se"] == pytest.approx(0.1)
    draw = random.Random(3)
    bin_of = lambda n: min(3, n + (draw.random() < 0.2))  # noqa: E731 - the attribute follows the length
    real = spark.createDataFrame([(i, n, "f", bin_of(n)) for i, n in ((i, i % 4) for i in range(2000))], "id bigint, length_bin int, attr string, bin int")
    rows = [(i, "short", 0, "f", bin_of(0)) for i in range(500)] + [(5000 + i, "odd", i % 4, "f", 0) for i in range(500)] + [(9000 + i, "far", 40, "f", 3) for i in range(200)]
    got = {r["arm"]: r for r in length_null(spark.createDataFrame(rows, "id bigint, arm string, length_bin int, attr string, bin int"), real, ["arm"]).collect()}
    assert got["short"]["jsd"] > 0.3 and abs(got["short"]["excess"]) < 0.03 and got["odd"]["excess"] > 0.3 and abs(got["far"]["excess"]) < 0.05


def test_labels_paths_and_answers(spark, tmp_path):
    d = spark.createDataFrame([("x", "v"), ("y", "q"), (None, "u")], "a string, b string")
    assert sorted(tuple(r) for r in encode_labels(d, VOCABULARY, ["a", "b"]).fillna(-1).collect()) == [(-1, 0), (0, 1), (1, -1)]
    assert spark.range(1).select(cyclic(F.array(F.lit(1), F.lit(2), F.lit(3)), 7).alias("c")).first()["c"] == [1, 2, 3, 1, 2, 3, 1]
    tags = spark.createDataFrame([("org/name/",), ("plain",)], "m string").select(model_tag(F.col("m")).alias("t")).collect()
    assert [r["t"] for r in tags] == ["name", "plain"]
    bad = spark.createDataFrame([('```json {"a": "x", "b": "no"}```',), ("no json",)], "t string")
    got = bad.select(in_vocabulary(parse_labels(F.col("t"), ["a", "b"]), VOCABULARY.options).alias("v")).select("v.*").collect()
    assert [tuple(r) for r in got] == [("x", None), (None, None)]
    with pytest.raises(Exception, match="(?i)malformed|failfast|parse"):
        bad.select(parse_labels(F.col("t"), ["a", "b"], strict=True).alias("v")).collect()
    wrong = spark.createDataFrame([("p", 1), ("p", 2), ("q", 3)], "pair string, id int")
    assert [tuple(r) for r in class_conflicts(wrong, ["pair"], "id").collect()] == [("p", 2)]
    with pytest.raises(Exception, match="several class ids"):
        class_map(wrong, ["pair"], "id").collect()
    logs = spark.createDataFrame([("r/seed3/m.jsonl", 0), ("r/seedX/m.jsonl", 1), ("m/lam0_seed2/m.jsonl", 2), ("m/lam0.0/m.jsonl", 3), ("m/lam0.5/m.jsonl", 4)], "log_path string, round int")
    assert sorted((r["method"], r["seed"], r["round"]) for r in two_methods(logs, logs, logs.where("round = 0").select("log_path")).collect()) == [("plain", 3, -1), ("plain", 3, 0), ("sweep", 0, 3), ("sweep", 2, 2)]
    assert metric_columns(spark.createDataFrame([(1.0, 2, "s", 3.0)], "jsd_a double, mauve int, jsd_b string, other double")) == ["jsd_a", "mauve"]
    root = f"file://{tmp_path}"
    with pytest.raises(FileNotFoundError):
        find_run_folders(spark, root)
    for name in ("ann/lam0.5_seed1", "ann/lam0", "ann/lamp"):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "round_0.csv").write_text("x")
    assert [f.rsplit("/", 1)[1] for f in find_run_folders(spark, root)] == ["lam0", "lam0.5_seed1"]
    write_settings(spark, {"k": 3, "blind": ["a"], "note": "two\nlines"}, f"{root}/settings")
    assert read_settings(spark, f"{root}/settings") == {"k": 3, "blind": ["a"], "note": "two\nlines"}
    write_split(spark.createDataFrame([(1, "ref"), (2, "query")], "id int, split string"), f"{root}/split")
    assert [r["id"] for r in spark.read.parquet(f"{root}/split/split=ref").collect()] == [1]


def test_tables_of_a_dataset_by_role(spark, tmp_path):
    root = f"file://{tmp_path}"
    dataset = Dataset(["a"], class_id="g", files={"private": "private", "aim": "aim_eps{eps}", "validation": "val.csv"}, budgets=PLAIN_BUDGETS)
    spark.createDataFrame([("t", "x", 1), (None, "y", 2)], "text string, a string, g int").write.parquet(f"{root}/private")
    spark.createDataFrame([("z",)], "a string").write.parquet(f"{root}/aim_eps4.0")
    (tmp_path / "val.csv").write_text('text,a\n"two\nlines",x\n,NA\n')
    assert load_role(spark, dataset, root, "private").count() == 1
    assert [tuple(r) for r in load_role(spark, dataset, root, "aim", 4.0).collect()] == [("z",)]
    assert [tuple(r) for r in load_role(spark, dataset, root, "aim", math.inf).collect()] == [("x", 1)]
    assert sorted((r["text"] or "", r["a"] or "") for r in load_role(spark, dataset, root, "validation", schema="text string, a string").collect()) == [("", ""), ("two\nlines", "x")]
    assert dataset_path(dataset, "/d/", "aim", 1.0) == "/d/aim_eps1.0"
    with pytest.raises(KeyError):
        dataset_path(dataset, "/d", "pool")
    s = Settings.of_budget(dataset, 2.0, 10, 6)
    assert (s.last, s.sigma, s.by) == (*PLAIN_BUDGETS[2.0], "g")


def test_annotators_and_saved_models(spark, tmp_path):
    calls = []

    def call(prompt):
        return json.dumps({"a": "x"}) if "red" in prompt else "sorry"

    df = spark.createDataFrame([(1, "red car", "y", "v"), (2, "blue sea", "y", None), (3, "red car", "y", "u")], "cand_id bigint, text string, a string, b string")
    label = service_annotator(VOCABULARY, ["a", "b"], call, "Label.", f"file://{tmp_path}/cache", "m")
    got = {r["cand_id"]: (r["loop_a"], r["loop_b"], r["a"], r["b"]) for r in labelled(df, label, ["a", "b"], "loop_").collect()}
    assert got == {1: ("x", "w", "y", "v"), 2: (None, None, "y", None), 3: ("x", "w", "y", "u")} and not calls
    train = spark.createDataFrame([(f"{w} {w} thing {i % 3}", l) for i in range(20) for w, l in (("red", "x"), ("blue", "y"))], "text string, label string")
    save_model(text_classifier(train), f"file://{tmp_path}/model")
    classify = classifier_annotator({"a": predictor(load_model(f"file://{tmp_path}/model"))}, VOCABULARY, ["a", "b"])
    got = {r["cand_id"]: (r["a"], r["b"]) for r in classify(df).collect()}
    assert got == {1: ("x", "v"), 2: ("y", "w"), 3: ("x", "u")}


def loop(spark, path, s, judge=None, **how):
    embed = lambda d: map_batches(d, "vector array<float>", hashed_embedding(size=8))
    text = F.concat(F.lit("word "), (F.col("id") % 7).cast("string"))
    start = spark.range(60).select(F.col("id").alias("cand_id"), text.alias("text"), (F.col("id") % 2).cast("int").alias("g"), (F.col("id") % 3).cast("string").alias("a"))
    voters = embed(spark.range(30).select("id", (F.col("id") % 2).cast("int").alias("g"), text.alias("text"))).select("id", "g", "vector")
    target = spark.createDataFrame([(0, "0"), (0, "1"), (1, "2")], "g int, a string")
    vary = lambda d, t: variations(d, s.variations, t, lambda x: x, 1 << 53)
    return run_loop(start, voters, target, s, path, embed, lambda d: d, vary, judge, **how)


def test_classes_have_their_own_k_and_marginals_in_the_loop(spark, tmp_path):
    s = Settings(k=0, variations=2, last=1, sigma=1.0, strength=1.0, mode="raked", blind=["a"], attributes=["a"], by="g", class_k={0: 8, 1: 4}, prior=20)
    judge = lambda d: d.withColumn("a", F.lit("1"))
    log = loop(spark, f"file://{tmp_path}/c", s, judge, diverge=lambda d: d.select("vector").count()).orderBy("round").collect()
    assert [r["round"] for r in log] == [-1, 0, 1] and [r["divergence"] for r in log] == [20, 12, 12]
    assert all(r["chosen"] == 12 for r in log[1:]) and log[1]["jsd_a"] == pytest.approx(log[2]["jsd_a"])
    last = spark.read.parquet(f"file://{tmp_path}/c/rounds/round=1").collect()
    assert Counter((r["g"], r["loop_a"]) for r in last) == {(0, "0"): 4, (0, "1"): 4, (1, "2"): 4}
    assert all(r["eval_a"] == "1" and r["a"] == r["loop_a"] for r in last)
    assert log[1]["marg_jsd_vs_phat_loop_labels"] < log[1]["marg_jsd_vs_phat_eval_labels"]


def test_kept_cells_and_grids(spark, tmp_path):
    cells = spark.createDataFrame([(c,) for c in "aaabbcd"], "cell string")
    assert {r["cell"]: round(r["p"] * 7) for r in target_cells(cells, 2).collect()} == {"a": 3, "__other__": 4}
    s = Settings(k=12, variations=1, last=0, sigma=0.0, mode="joint", blind=["a"], attributes=["a"], max_cells=2)
    runs = grid(["ann"], [0.0, 1.0], [0], s)
    assert list(runs) == ["ann/lam0_seed0", "ann/lam1_seed0"]
    log = sweep(runs, f"file://{tmp_path}/g", lambda own, path: loop(spark, path, own)).collect()
    assert {r["run"]: r["chosen"] for r in log} == {"ann/lam0_seed0": 12, "ann/lam1_seed0": 12}
    one = spark.read.parquet(f"file://{tmp_path}/g/ann/lam1_seed0/rounds/round=0").groupBy("loop_a").count().collect()
    assert {r["loop_a"]: r["count"] for r in one}.get("0") == 4  # kept: a third; the other two share a cell
