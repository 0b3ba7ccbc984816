from pyspark.sql import functions as F

import __spark_entry__ as driver
from skewloom.operators.loop import AnnotatorRegistry, Settings, run_loop, variations
from skewloom.operators.ml import divergence_score, probe_kappa
from skewloom.sources.caches import annotations_to_do, through_cache
from skewloom.sources.connectors import hashed_embedding, map_batches
from skewloom import storage
from skewloom.storage import forget, shared_dir, temporary_tables, written

SF = "/root/testdata/sf0.001"


def embed(d):
    return map_batches(d, "vector array<float>", hashed_embedding(size=16))


def loop(spark, path, calls, mode="plain", last=2):
    text = F.concat(F.lit("word "), (F.col("id") % 7).cast("string"), F.lit(" tail "), (F.col("id") % 3).cast("string"))
    start = spark.range(30).select(F.col("id").alias("cand_id"), text.alias("text"), (F.col("id") % 2).cast("string").alias("a"), (F.col("id") % 3).cast("string").alias("b"))
    voters = embed(spark.range(40).select("id", text.alias("text"))).select("id", "vector")
    target = spark.createDataFrame([("0", "1"), ("1", "1"), ("1", "2")], "a string, b string")
    s = Settings(k=10, variations=2, last=last, sigma=1.0, strength=0.5, mode=mode, blind=["a", "b"], attributes=["a", "b"])

    def vary(d, t):
        calls.append((t, d.count() * s.variations))
        return variations(d, s.variations, t, lambda x: x.withColumn("text", F.concat("text", F.lit(" v"))), 1 << 53)

    return run_loop(start, voters, target, s, path, embed, lambda d: d, vary)


def test_rounds_and_resume(spark, tmp_path):
    for mode in ("plain", "joint", "raked"):
        path, calls = f"file://{tmp_path}/{mode}", []
        log = loop(spark, path, calls, mode)
        assert calls == [(1, 20), (2, 20)] and sorted(r["round"] for r in log.collect()) == [0, 1, 2]
        assert all(r["chosen"] == 10 for r in log.collect())
        assert spark.read.parquet(f"{path}/rounds").count() == 30
    first = {r["cand_id"] for r in spark.read.parquet(f"{path}/rounds/round=2").collect()}
    stopped, calls = f"file://{tmp_path}/stopped", []
    loop(spark, stopped, calls, "raked", last=1)
    loop(spark, stopped, calls, "raked", last=2)
    assert [t for t, _ in calls] == [1, 2]  # the resumed loop makes only the missing round
    assert {r["cand_id"] for r in spark.read.parquet(f"{stopped}/rounds/round=2").collect()} == first


def test_cache_computes_each_text_once(spark, tmp_path):
    seen = []

    def compute(d):
        seen.append(d.count())
        return d.withColumn("n", F.length("text"))

    df = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "aa"), (4, None)], "row_id bigint, text string")
    path = f"file://{tmp_path}/cache"
    for _ in range(2):
        got = {r["row_id"]: r["n"] for r in through_cache(df, path, compute, "m").collect()}
        assert got[1] == got[3] == 2 and got[2] == 1
    assert seen == [2]
    through_cache(df, path, compute, "other")
    assert len(seen) == 2
    log = spark.createDataFrame([(1, 1, "x", None), (2, 1, None, "e"), (2, 2, None, "e"), (3, 1, None, "e"), (3, 2, "y", None)], "row_id bigint, n int, labels string, error string")
    assert sorted(r[0] for r in annotations_to_do(df.select("row_id"), log, "row_id", "n", retry_errors=True).collect()) == [2, 4]
    assert sorted(r[0] for r in annotations_to_do(df.select("row_id"), log, "row_id", "n").collect()) == [4]


def test_registry(spark):
    r = AnnotatorRegistry({"same": lambda d: d})
    r.register("up", lambda d: d.withColumn("a", F.upper("a")))
    assert r.label("up", spark.createDataFrame([("x",)], "a string")).first()["a"] == "X"


def test_probe_and_divergence(spark):
    rows = [(i, [float(i % 2) * 4 + (i % 5) * 0.1, 1.0], str(i % 2)) for i in range(80)]
    d = spark.createDataFrame(rows, "id bigint, vector array<double>, label string")
    assert probe_kappa(d.where("id < 40"), d.where("id >= 40")) > 0.95
    assert probe_kappa(d.where("label = '0'"), d) is None
    far = d.withColumn("vector", F.transform("vector", lambda x: x + 50))
    assert divergence_score(d, d, 4) > 0.99 and divergence_score(d, far, 4) < 0.2


def test_written_tables(spark):
    t = written(spark.range(5).select(F.col("id").alias("x")))
    assert t.count() == 5 and t._skewloom_path.startswith(shared_dir(spark))
    forget(t)
    forget(None)
    with temporary_tables():
        inside = written(spark.range(3).toDF("x"))
        assert inside.count() == 3
    assert inside._skewloom_path not in storage._WRITTEN


def test_every_query_has_rows_or_a_schema_and_sql_names_match(spark):
    q, sql = driver.queries(), driver.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 80
    assert driver.entry(spark).count() > 0


def test_queries_equal_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    from pathlib import Path

    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    q, sql = driver.queries(), driver.oracle_sql()
    for name in ("quota_topk_by_cell", "lambda_sweep_one_job", "clean_labels_private", "knn5_neighbours", "within_class_kappa", "jsd_per_attr", "length_matched_pool", "by_round_unpivot", "surface_features", "leave_one_out_rho"):
        a, b = q[name](spark, SF).toPandas(), con.execute(sql[name]).fetchdf()
        assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b), name
        key = lambda d: sorted(tuple("" if v is None or v != v else f"{v:.5g}" if isinstance(v, float) else str(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False))
        assert key(a) == key(b), name
