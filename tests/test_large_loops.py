import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from skewloom.operators import knn
from skewloom.operators.loop import Settings, run_loop, variations
from skewloom.sources.connectors import hashed_embedding, map_batches


def vectors(spark, x, by=None, first=0):
    rows = [(first + i, [float(v) for v in row], None if by is None else int(by[i])) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, vector array<double>, g int")


def brute(q, x, ids):
    return [min(range(len(x)), key=lambda i: (((x[i] - v) ** 2).sum(), ids[i])) for v in q]


def rounds(spark, path, **how):
    """A loop of two rounds in which an accumulator counts the embedded texts."""
    seen, embedding = spark.sparkContext.accumulator(0), hashed_embedding(size=16)

    def counted(b):
        seen.add(len(b))
        return embedding(b)

    embed = lambda d: map_batches(d, "vector array<float>", counted)
    text = F.concat(F.lit("word "), (F.col("id") % 7).cast("string"), F.lit(" tail "), (F.col("id") % 3).cast("string"))
    start = spark.range(30).select(
        F.col("id").alias("cand_id"), (F.col("id") % 2).alias("class"), text.alias("text"), (F.col("id") % 2).cast("string").alias("a"), (F.col("id") % 3).cast("string").alias("b")
    )
    voters = embed(spark.range(40).select("id", (F.col("id") % 2).alias("class"), text.alias("text"))).select("id", "class", "vector")
    target = spark.createDataFrame([("0", "1", 0), ("1", "1", 1), ("1", "2", 0)], "a string, b string, class bigint")
    s = Settings(k=10, variations=2, last=1, sigma=1.0, blind=["a", "b"], attributes=["a", "b"], **how)
    vary = lambda d, t: variations(d, s.variations, t, lambda x: x.withColumn("text", F.concat("text", F.lit(" v"))), 1 << 53)
    log = run_loop(start, voters, target, s, path, embed, lambda d: d, vary).collect()
    assert sorted(r["round"] for r in log) == [0, 1] and all(r["chosen"] == 10 for r in log)
    return seen.value


def test_plain_rounds_embed_each_text_once(spark, tmp_path):
    assert rounds(spark, f"file://{tmp_path}/plain") == 40 + 30 + 30  # voters, and 10 survivors with 20 variations


def test_nearest_in_single_floats_equals_brute_force(monkeypatch):
    monkeypatch.setattr(knn, "TILE", (7, 5))
    draw = np.random.default_rng(4)
    shapes = [draw.integers(0, 3, (90, 4)).astype(float), draw.normal(size=(90, 64)), 1e-9 * draw.normal(size=(90, 8)) + 1e-4, 3e4 + draw.normal(size=(90, 6))]
    near = np.repeat(draw.normal(size=(9, 5)), 10, axis=0)
    shapes.append(near + 1e-12 * draw.normal(size=near.shape))  # told apart in double precision only
    for x in shapes:
        for ids in (draw.permutation(60), np.array([f"k{i:02d}" for i in draw.permutation(60)], dtype=object)):
            found, away = knn._closest(x[50:], ids, x[:60])
            best = brute(x[50:], x[:60], ids)
            assert list(found) == [ids[i] for i in best]
            assert list(away) == [((x[i] - v) ** 2).sum() for i, v in zip(best, x[50:])]
    assert knn._closest(x, np.arange(2), np.ones((2, 5))) is None  # all alike
    assert knn._closest(np.full((1, 5), np.nan), np.arange(90), x) is None


def test_equal_vectors_are_searched_once_and_ids_vote_once(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(12, 6))
    cands, voters = vectors(spark, np.repeat(x, 5, axis=0)), vectors(spark, np.repeat(x + 0.01, 4, axis=0), first=1000)
    sizes, nearest = [], knn.nearest
    monkeypatch.setattr(knn, "nearest", lambda q, r, k, by=None: sizes.append((q.count(), r.count())) or nearest(q, r, k, by))
    votes = {r["cand_id"]: r["votes"] for r in knn.vote_histogram(voters, cands).collect()}
    assert votes == {i: 4 if i % 5 == 0 else 0 for i in range(60)} and sizes == [(12, 12)]
    twice = voters.unionByName(vectors(spark, x[:1] + 0.02, first=1000))
    assert {r["cand_id"]: r["votes"] for r in knn.vote_histogram(twice, cands).collect()} == votes


def test_embedding_is_as_published():
    import zlib

    texts = ["One two two THREE", "", None, "x", "a b a b a"]
    for t, v in zip(texts, hashed_embedding(size=8)(pd.DataFrame({"text": texts}))["vector"]):
        w, want = (t or "").lower().split(), np.zeros(8, dtype=np.float32)
        for g in (*w, *(f"{p} {q}" for p, q in zip(w, w[1:]))):
            h = zlib.crc32(g.encode())
            want[h % 8] += 1 if h & 0x80000000 else -1
        n = np.linalg.norm(want)
        assert np.array_equal(v, want / (n if n > 0 else 1))


def test_raked_rounds_embed_each_text_once(spark, tmp_path):
    assert rounds(spark, f"file://{tmp_path}/raked", mode="raked", strength=0.5) == 40 + 30 + 30


def test_rounds_by_class_embed_each_text_once(spark, tmp_path):
    assert rounds(spark, f"file://{tmp_path}/class", mode="raked", strength=0.5, by="class", class_k={0: 5, 1: 5}) == 40 + 30 + 30


def test_votes_by_class_over_blocks_equal_brute_force(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(80, 6))
    g = np.arange(80) % 3
    monkeypatch.setattr(knn, "BLOCK_ROWS", 5)
    monkeypatch.setattr(knn, "GRID_TASKS", 9)
    want = dict.fromkeys(range(50), 0)
    for i in range(50, 80):
        own = [j for j in range(50) if g[j] == g[i]]
        want[own[brute(x[i : i + 1], x[own], own)[0]]] += 1
    got = knn.vote_histogram(vectors(spark, x[50:], g[50:], first=50), vectors(spark, x[:50], g[:50]), by="g")
    assert {r["cand_id"]: r["votes"] for r in got.collect()} == want


def test_raked_rounds_label_the_target_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(b):
        seen.add(len(b))
        return pd.DataFrame({"a": (b["id"] % 2).astype(str)})

    embed = lambda d: map_batches(d, "vector array<float>", hashed_embedding(size=16))
    text = F.concat(F.lit("word "), (F.col("id") % 7).cast("string")).alias("text")
    start = spark.range(30).select(F.col("id").alias("cand_id"), text, (F.col("id") % 3 % 2).cast("string").alias("a"))
    voters = embed(spark.range(40).select("id", text)).select("id", "vector")
    target = map_batches(spark.range(12), "a string", counted)
    s = Settings(k=10, variations=2, last=1, sigma=1.0, strength=0.5, mode="raked", blind=["a"], attributes=["a"])
    vary = lambda d, t: variations(d, s.variations, t, lambda x: x, 1 << 53)
    assert run_loop(start, voters, target, s, f"file://{tmp_path}/target", embed, lambda d: d, vary).count() == 2
    assert seen.value == 12


def test_embedding_hashes_each_word_once_and_no_pairs(monkeypatch):
    import zlib

    draw, words = np.random.default_rng(7), [f"w{'é' * (i % 4)}{i}" for i in range(30)]
    texts = [" ".join(words[i] for i in draw.integers(0, 30, 60)) for _ in range(450)] + ["b " + "c" * 70_000, " ", None]
    want, hashed, crc32 = [], [], zlib.crc32
    for t in texts:
        w, n = (t or "").lower().split(), np.zeros(24, dtype=np.float32)
        for g in (*w, *(f"{p} {q}" for p, q in zip(w, w[1:]))):
            h = crc32(g.encode())
            n[h % 24] += 1 if h & 0x80000000 else -1
        want.append(n / (np.linalg.norm(n) or 1))
    monkeypatch.setattr(zlib, "crc32", lambda data, *more: hashed.append(data) or crc32(data, *more))
    assert np.array_equal(np.stack(hashed_embedding(size=24)(pd.DataFrame({"text": texts}))["vector"]), np.stack(want))
    assert len([h for h in hashed if h.strip(b"\0")]) <= 2 * 32


def test_pairs_of_blocks_have_partitions_of_their_own(spark, monkeypatch):
    x = np.random.default_rng(8).normal(size=(80, 6))
    g = np.arange(80) % 3
    monkeypatch.setattr(knn, "BLOCK_ROWS", 5)
    found = knn._grid(vectors(spark, x[50:], g[50:], first=50), vectors(spark, x[:50], g[:50]), 1, "g", "query_id bigint, ref_id bigint, distance double")
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > int(spark.conf.get("spark.sql.shuffle.partitions"))
