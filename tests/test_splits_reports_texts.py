import json
import math
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skewloom.functions.distributions import incomplete_beta, spearman_p, t_quantile
from skewloom.functions.hashrng import normal, uniform
from skewloom.functions.labels import clean_labels, clean_value, group_key, has_text, labels_from_map, length_bin, word_count
from skewloom.functions.text import features
from skewloom.operators.histograms import bin_among, bin_of, exact_quantiles, length_weights, nearest_bin
from skewloom.operators.rankstats import average_rank, bootstrap_interval, fisher_difference, permutation_p, spearman, with_t_interval
from skewloom.operators.report import change_first_last, paired_differences, replicate_baseline
from skewloom.operators.splits import copies_and_remainder, group_split, half_split, length_matched, one_per_group
from skewloom.sources.connectors import call_with_retries, parse_labels
from skewloom.sources.runlog import join_side_file, keep_last, path_fields, read_logs
from skewloom.sources.sinks import append_log, markdown, write_round
from skewloom.sources.tables import add_class_id, check_root, class_map, read_csv, shards
from skewloom.spec import PLAIN_BUDGETS, TAGGED_BUDGETS, Dataset, Vocabulary, rescale_noise, scheduled_strength


def test_halves_and_groups(spark):
    df = spark.createDataFrame([(i, f"g{i // 4}", None if i % 9 == 0 else "v") for i in range(401)], "row_id bigint, grp string, x string")
    halves = Counter(r["split"] for r in half_split(df, "row_id").collect())
    assert halves == {"ref": 200, "query": 201}
    rows = group_split(df, ["grp"], [("train", 0.7), ("val", 0.15), ("test", 0.15)]).collect()
    side = {}
    for r in rows:
        assert side.setdefault(r["grp"], r["split"]) == r["split"]
    n = Counter(r["split"] for r in rows)
    assert abs(n["train"] - 281) <= 4 and abs(n["val"] - 60) <= 5
    half = Counter(r["split"] for r in group_split(df, ["grp", "x"], [("ref", 0.5), ("query", 0.5)], floor_rows=True).collect())
    assert abs(half["ref"] - 200) <= 4 and half["ref"] <= 200


def test_one_per_group_and_copies(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(10)], "row_id bigint, klass int")
    assert sorted(r["klass"] for r in one_per_group(df, "klass", "row_id").collect()) == [0, 1, 2]
    wanted = spark.createDataFrame([(0, 9), (1, 2), (2, 0)], "klass int, m bigint")
    got = copies_and_remainder(df, "klass", "row_id", wanted).collect()
    assert Counter(r["klass"] for r in got) == {0: 9, 1: 2}
    assert Counter(Counter(r["row_id"] for r in got if r["klass"] == 0).values()) == {2: 3, 3: 1}


def test_length_matching(spark):
    draw = np.random.default_rng(0)
    p = spark.createDataFrame([(int(b),) for b in draw.choice([100, 200, 300], 600, p=[0.5, 0.3, 0.2])], "bin int")
    q = spark.createDataFrame([(i, int(b)) for i, b in enumerate(draw.choice([100, 200, 300, 600], 900, p=[0.1, 0.2, 0.3, 0.4]))], "row_id bigint, bin int")
    got = length_matched(q, p, "row_id", "bin").collect()
    want = {r["bin"]: r["count"] / 600 for r in p.groupBy("bin").count().collect()}
    have = Counter(r["bin"] for r in got)
    assert 150 < len(got) < 260 and 600 not in have and got[0]["covered"] == pytest.approx(1)
    assert all(abs(have[b] / len(got) - s) < 0.01 for b, s in want.items())
    w = length_weights(q, p, "bin").groupBy("bin").agg(F.sum("weight").alias("w")).collect()
    total = sum(r["w"] for r in w)
    assert all(r["w"] / total == pytest.approx(want[r["bin"]]) for r in w)


def test_exact_quantiles(spark):
    draw = np.random.default_rng(5)
    x, y = draw.normal(size=999), draw.integers(0, 5, 999).astype(float)
    y[:3] = [1e9, np.nan, -1e9]
    df = spark.createDataFrame([(float(a), float(b), 7.0, None) for a, b in zip(x, y)] + [(None, None, None, None)], "x double, y double, z double, w double")
    got = exact_quantiles(df, ["x", "y", "z", "w"], [0.0, 0.1, 0.5, 0.93, 1.0])
    assert np.allclose(got["x"], np.quantile(x, [0, 0.1, 0.5, 0.93, 1])) and np.allclose(got["y"], np.quantile(y[~np.isnan(y)], [0, 0.1, 0.5, 0.93, 1]))
    assert got["z"] == [7.0] * 5 and got["w"] == []
    assert df.limit(0).count() == 0 and exact_quantiles(df.limit(0), ["x"], [0.5]) == {"x": []}
    assert df.where("x is not null").select(bin_among(F.col("z"), [1.0, 7.0, 9.0]).alias("b")).first()["b"] == 2


def test_shards_and_nearest_bin(spark):
    d = spark.createDataFrame([(i,) for i in range(10)], "i bigint")
    got = [r["i"] for r in shards(d, "i", 4).orderBy("merged").collect()]
    assert got == [0, 4, 8, 1, 5, 9, 2, 6, 3, 7]
    near = nearest_bin(spark.createDataFrame([(4,), (5,), (99,)], "v int"), spark.createDataFrame([(2,), (6,), (10,)], "b int"), "v", "b")
    assert [r["nearest"] for r in near.orderBy("v").collect()] == [2, 6, 10]
    assert spark.createDataFrame([([1.0, 2.0], 2.0)], "e array<double>, x double").select(bin_of(F.col("x"), F.col("e"))).first()[0] == 2


OPTIONS = ["Cell", "Cell Biology", "Other"]


@pytest.mark.parametrize(("value", "want"), [("Cell", "Cell"), (" Cell Biology ", "Cell Biology"), ("Cell Bio", "Cell"), ("Oth", "Other"), ("cell", "none"), (None, "none"), ("  ", "Cell")])
def test_cleaning(spark, value, want):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(clean_value(F.col("v"), OPTIONS, "none")).first()[0] == want


def test_labels(spark):
    v = Vocabulary({"a": OPTIONS, "b": ["x"]}, {"a": "Other", "b": "x"})
    df = spark.createDataFrame([("Cell", None, "a b", "u"), (None, None, None, None)], "map_a string, map_b string, text string, z string")
    got = labels_from_map(df, v, ["a", "b"]).collect()
    assert (got[0]["map_a"], got[0]["map_b"]) == ("Cell", "x") and got[1]["map_a"] is None and got[1]["map_b"] is None
    rows = clean_labels(df, v, ["word_count", "z"]).collect()
    assert [r["word_count"] for r in rows] == ["0", "0"] and [r["z"] for r in rows] == ["u", "nan"]
    n = spark.createDataFrame([(25,), (75,), (125,), (26,)], "n int").select(length_bin(F.col("n"))).collect()
    assert [r[0] for r in n] == ["0", "100", "100", "50"]
    t = spark.createDataFrame([("a b c\n d",), ("",), (" ",)], "t string")
    assert [r[0] for r in t.select(word_count(F.col("t"))).collect()] == [4, 0, 0]
    assert [r[0] for r in t.select(has_text(F.col("t"))).collect()] == [True, False, False]
    keys = spark.createDataFrame([("x", 1.0, "u"), (None, 2.0, "v")], "a string, b double, c string").select(group_key(["a", "b", "c"]))
    assert [r[0] for r in keys.collect()] == ["x|1.0|u", "nan|2.0|v"]


def test_text_features(spark):
    text = "We may suggest that DNA was measured in 12 mice (p < 0.05). It seems fine!"
    row = spark.createDataFrame([(text,), ("",)], "t string").select(*(c.alias(n) for n, c in features(F.col("t")).items())).collect()
    assert row[0]["has_statistic"] == 1 and row[0]["word_count"] == 16 and row[0]["hedge_rate"] == pytest.approx(2 / 15) and row[0]["acronym_rate"] == pytest.approx(1 / 15)  # numbers are tokens; 'seems' is no hedge
    assert row[0]["passive_per_sentence"] == pytest.approx(1 / 2) and row[1]["word_count"] == 0 and row[1]["moving_ttr"] == 0


def test_statistics(spark):
    x, y = [1.0, 2.0, 2.0, 4.0, 5.0], [2.0, 1.0, 4.0, 3.0, 5.0]
    df = spark.createDataFrame(list(zip(x, y)), "x double, y double")
    assert [r[0] for r in df.select(average_rank("x").alias("r")).orderBy("r").collect()] == [1, 2.5, 2.5, 4, 5]
    rho = spearman(df, "x", "y").first()["rho"]
    assert rho == pytest.approx(np.corrcoef([1, 2.5, 2.5, 4, 5], [2, 1, 4, 3, 5])[0, 1])
    assert t_quantile(0.975, 4) == pytest.approx(2.7764451, abs=1e-6) and t_quantile(0.975, 100) == pytest.approx(1.9839715, abs=1e-6)
    assert incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248) and spearman_p(0.6, 10) == pytest.approx(0.0667, abs=1e-3)
    assert permutation_p([1, 2, 3, 4], [1, 2, 3, 4]) == pytest.approx(2 / 24)
    low, high = bootstrap_interval(range(20), range(20), 200)
    assert low == pytest.approx(1) and high == pytest.approx(1)
    z, p = fisher_difference(0.5, 103, 0.5, 103)
    assert z == 0 and p == pytest.approx(1) and math.isnan(fisher_difference(1.0, 9, 0.5, 9)[0])


def test_hashed_noise_is_normal_and_reproducible(spark):
    d = spark.range(20_000).select(uniform(1, "u", F.col("id")).alias("u"), normal(1, "n", F.col("id")).alias("z")).toPandas()
    assert abs(d["u"].mean() - 0.5) < 0.01 and abs(d["z"].mean()) < 0.03 and abs(d["z"].std() - 1) < 0.02


def test_budgets_and_schedules():
    assert TAGGED_BUDGETS[1.0] == (2, 6.8692) and PLAIN_BUDGETS[math.inf] == (9, 0.0)
    assert 5 / (2 * rescale_noise(2.5, 3, 5) ** 2) == pytest.approx(3 / (2 * 2.5**2))
    assert scheduled_strength(1, 4, 0.8, "linear") == pytest.approx(0.2) and scheduled_strength(0, 0, 0.8, "linear") == 0.8
    d = Dataset(["a", "b"], class_attributes=["a"], budgets=TAGGED_BUDGETS)
    assert d.candidates == ["b"] and d.budget(4.0) == (4, 2.5788)
    with pytest.raises(KeyError):
        d.budget(3.0)


def test_run_logs(spark, tmp_path):
    for name, lines in {"maple-ft/lam0_seed1": [(0, 0.5), (1, 9.0), (1, 0.4)], "cls-ft/lam0.5_seed1": [(0, 0.3)], "cls-ft/other": [(0, 1.0)]}.items():
        folder = tmp_path / name
        folder.mkdir(parents=True)
        (folder / "metrics.jsonl").write_text("".join(json.dumps({"round": r, "jsd": v}) + "\n" for r, v in lines))
    (tmp_path / "maple-ft/lam0_seed1/DONE").write_text("")
    logs = path_fields(read_logs(spark, f"{tmp_path}/*/*/metrics.jsonl", "round int, jsd double"), "log_path")
    kept = keep_last(logs, ["annotator", "lam", "seed", "round"], [F.col("line_no")])
    got = sorted((r["annotator"], r["lam"], r["seed"], r["round"], r["jsd"], r["done"]) for r in kept.collect())
    assert got == [("cls-ft", 0.5, 1, 0, 0.3, False), ("maple-ft", 0.0, 1, 0, 0.5, True), ("maple-ft", 0.0, 1, 1, 0.4, True)]
    shown = replicate_baseline(kept.select("annotator", "lam", "seed", "round", "jsd"), "maple").collect()
    assert Counter(r["annotator"] for r in shown) == {"cls-ft": 3}
    side = spark.createDataFrame([(1, 1, 7.0), (1, 2, 8.0)], "round int, line_no int, mauve_x double")
    assert [r["mauve_x"] for r in join_side_file(spark.createDataFrame([(0,), (1,)], "round int"), side, ["round"]).orderBy("round").collect()] == [None, 8.0]


def test_paired_differences_and_changes(spark):
    rows = [("m", lam, s, float(s) + (0.25 if lam else 0.0)) for lam in (0.0, 0.5) for s in range(5)]
    d = spark.createDataFrame(rows, "annotator string, lam double, seed int, x double")
    r = paired_differences(d.where("lam > 0"), d.where("lam = 0"), ["annotator", "seed"], ["annotator", "lam"], ["x"]).first()
    assert (r["mean"], r["n"]) == (0.25, 5) and r["sd"] == pytest.approx(0, abs=1e-12)
    long = spark.createDataFrame([("a", s, t, s + 0.1 * t + 0.01 * s * t) for s in range(3) for t in range(4)] + [("b", 0, 0, 1.0), ("b", 0, 1, 2.0), ("c", 0, 1, 1.0), ("c", 0, 2, 9.0)], "metric string, seed int, round int, value double")
    got = {r["metric"]: r for r in change_first_last(long, ["metric"], ["seed"], 0).collect()}
    assert got["a"]["verdict"] == "up" and got["b"]["verdict"] == "n<2" and "c" not in got
    ci = with_t_interval(spark.createDataFrame([(1.0, 5), (None, 1)], "sd double, n bigint"), "sd", "n").orderBy("n").collect()
    assert ci[0]["ci95"] is None and ci[1]["ci95"] == pytest.approx(2.7764451 / math.sqrt(5), abs=1e-6)
    assert statistics.mean([1, 3]) == 2


def test_connectors():
    calls = []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise OSError("busy")
        return "ok"

    assert call_with_retries(flaky, "p", pause=lambda s: None) == ("ok", None)
    answer, error = call_with_retries(lambda p: 1 / 0, "p", retries=2, pause=lambda s: None)
    assert answer is None and "ZeroDivision" in error


def test_tolerant_json(spark):
    df = spark.createDataFrame([('```json\n{"a": "x"}\n```',), ("sorry",), (None,)], "r string")
    assert [r[0] for r in df.select(parse_labels(F.col("r"), ["a"])["a"]).collect()] == ["x", None, None]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,word count,text\n"x, y",3,"two\nlines ""q"""\nN/A,,z\n')
    rows = read_csv(spark, str(tmp_path / "t.csv"), "a string, `word count` int, text string").collect()
    assert [tuple(r) for r in rows] == [("x, y", 3, 'two\nlines "q"'), (None, None, "z")]
    df = spark.createDataFrame([(1, "u")], "cand_id bigint, text string")
    write_round(df, str(tmp_path / "rounds"), 0)
    write_round(df, str(tmp_path / "rounds"), 0)
    append_log(df, str(tmp_path / "log"))
    append_log(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "rounds")).count() == 1 and spark.read.json(str(tmp_path / "log")).count() == 2
    assert markdown(df).splitlines()[0] == "| cand_id | text |"
    (tmp_path / "DATASET").write_text("second\n")
    check_root(spark, str(tmp_path), "second", "first")
    with pytest.raises(ValueError, match="belongs to second"):
        check_root(spark, str(tmp_path), "first", "first")
    pairs = spark.createDataFrame([("a", "b", 1), ("a", "b", 1), ("a", "c", 2)], "x string, y string, g int")
    m = class_map(pairs, ["x", "y"], "g")
    assert m.count() == 2
    with pytest.raises(Exception, match="several class ids"):
        class_map(pairs.union(spark.createDataFrame([("a", "b", 9)], pairs.schema)), ["x", "y"], "g").collect()
    assert add_class_id(spark.createDataFrame([("a", "c"), ("q", "q")], "x string, y string"), m, ["x", "y"], "g").collect()[0]["g"] == 2
