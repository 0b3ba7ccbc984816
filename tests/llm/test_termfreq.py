from datetime import datetime

from skewloom.llm.termfreq import term_frequency

SCHEMA = "row_id bigint, a string, b string, at timestamp, term string, attr string"


def t(h):
    return datetime(2024, 1, 1, h)


def run(spark, rows, **how):
    got = term_frequency(spark.createDataFrame(rows, SCHEMA), "row_id", ["a", "b"], "at", **how).collect()
    return {(r["attr"], r["term"]): (r["occurrences"], r["records"], r["mark"]) for r in got}


def test_counts_terms_by_occurrence_and_record(spark):
    rows = [(i, "Human; mouse |human", None, t(1), "clash", "clash") for i in range(10)] + [(10, " Zebra  fish\t;;", "x", t(1), "", "")]
    got = run(spark, rows)
    assert got[("a", "human")] == (20, 10, "common")
    assert got[("a", "mouse")] == (10, 10, "common")
    assert got[("a", "zebra fish")] == (1, 1, "rare")
    assert got[("b", "x")] == (1, 1, "rare")
    assert len(got) == 4


def test_the_last_delivery_of_a_record_counts_once(spark):
    rows = [(1, "old", "", t(1), "", ""), (1, "new", None, t(2), "", ""), (1, "new", None, t(2), "", ""), (None, "lost", "", t(1), "", "")]
    assert run(spark, rows) == {("a", "new"): (1, 1, "rare")}


def test_marks_at_the_bounds(spark):
    rows = [(i, "w" if i < 2 else "v" if i < 5 else "u", None, t(1), "", "") for i in range(30)]
    got = run(spark, rows)
    assert got[("a", "w")][2] == "rare" and got[("a", "v")][2] is None and got[("a", "u")][2] == "common"


def test_long_cells_and_empty_tables(spark):
    rows = [(1, ";".join(["q"] * 20_000 + ["z" * 50_000]), "", t(1), "", "")]
    got = run(spark, rows)
    assert got[("a", "q")][:2] == (20_000, 1) and got[("a", "z" * 50_000)][:2] == (1, 1)
    assert run(spark, []) == {}
