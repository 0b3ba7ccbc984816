import json

from pyspark.sql import functions as F

from skewloom.streaming.runlog_stream import follow_run_logs, read_state, windowed_counts


def test_state_follows_the_logs_and_keeps_the_last_line(spark, tmp_path):
    logs, state, sums = tmp_path / "logs", f"file://{tmp_path}/state", []

    def add(name, rows):
        folder = logs / "cls-ft" / name
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"part{len(list(folder.iterdir()))}.jsonl").write_text("".join(json.dumps({"round": r, "at": t, "jsd": v}) + "\n" for r, t, v in rows))

    def run():
        q = follow_run_logs(spark, f"file://{logs}", "round int, at int, jsd double", state, f"file://{tmp_path}/check", "at", lambda d: sums.append(d.agg(F.sum("jsd")).first()[0]))
        q.awaitTermination()

    add("lam0_seed1", [(0, 1, 0.5), (1, 2, 0.4)])
    run()
    add("lam0_seed1", [(1, 3, 0.1)])
    add("lam0.5", [(0, 1, 0.2)])
    run()
    got = sorted((r["lam"], r["seed"], r["round"], r["jsd"]) for r in read_state(spark, state).collect())
    assert got == [(0.0, 1, 0, 0.5), (0.0, 1, 1, 0.1), (0.5, 0, 0, 0.2)]
    assert abs(sums[-1] - 0.8) < 1e-9
    assert read_state(spark, f"{state}-none") is None


def test_windowed_counts_of_a_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    got = windowed_counts(e, "ts")
    assert got.agg(F.sum("n")).first()[0] == e.count()
