import random

import numpy as np

from skewloom.llm import truncation as module
from skewloom.llm.truncation import cut_short, features, gap_feature, gap_to, length_limits, line_kind, source_limits, truncation_rates, truncation_scores

NOUNS = ["river", "mill", "bridge", "market", "tower", "harbour", "library", "orchard"]


def sentence(draw):
    return f"The {draw.choice(NOUNS)} of {draw.choice(['Davi', 'Sorna', 'Kelu'])} was {draw.choice(['built', 'sold', 'renamed'])} in {draw.randint(1700, 1990)} by {draw.choice(NOUNS)} keepers."


def article(draw, n):
    body = " ".join(sentence(draw) for _ in range(n))
    return body + draw.choice(["", "\n\n[[Category:Davi rivers]]", "\n\n{{stub}}", "\n\n* [[Sorna]]"])


def corpus(seed, n=700):
    draw = random.Random(seed)
    rows, cut = [], set()
    for i in range(n):
        text, source = article(draw, draw.randint(3, 14)), draw.choice(["whole", "limited", "feed"])
        if source == "limited" and len(text) > 500:
            text = text[:500]
        if source == "feed" and draw.random() < 0.3:
            text = text[: draw.randint(60, len(text) - 30)]
        if not text.rstrip().endswith((".", "]]", "}}")):
            cut.add(i)
        rows.append((i, text, source, 0.5))
    return rows, cut


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, score double")


def test_held_out_accuracy_and_rates(spark):
    rows, cut = corpus(1)
    scores = truncation_scores(frame(spark, rows), "doc_id", "text", "source").collect()
    got = {r["id"] for r in scores if r["truncated"]}
    assert len(scores) == len(rows)
    assert len(got & cut) / len(got) > 0.93 and len(got & cut) / len(cut) > 0.93
    rates = {r["source"]: r["rate"] for r in truncation_rates(truncation_scores(frame(spark, rows), "doc_id", "text", "source")).collect()}
    assert rates["whole"] < 0.03 and rates["limited"] > 0.4 and 0.15 < rates["feed"] < 0.4


def test_the_fit_does_not_depend_on_partitions(spark):
    rows, _ = corpus(2, 300)
    one, two = (sorted((r["id"], round(r["score"], 4)) for r in truncation_scores(d, "doc_id", "text", "source").collect()) for d in (frame(spark, rows), frame(spark, rows).repartition(7)))
    assert one == two


def test_nulls_blanks_repeats_long_and_empty(spark):
    rows, _ = corpus(3, 200)
    extra = [(900, None, "whole", 0.1), (901, " \n", None, 0.1), (902, "", "whole", 0.1), (903, rows[0][1], "whole", 0.1), (903, rows[0][1], "whole", 0.1), (None, rows[1][1], None, 0.1), (904, "The tower stands. " * 20_000, "whole", 0.1)]
    got = truncation_scores(frame(spark, rows + extra), "doc_id", "text", "source").collect()
    assert len(got) == len(rows) + len(extra)
    by = {r["id"]: r for r in got}
    assert all(by[i]["score"] == 0 and not by[i]["truncated"] for i in (900, 901, 902)) and not by[904]["truncated"]
    assert truncation_scores(frame(spark, []), "doc_id", "text", "source").count() == 0
    few = truncation_scores(frame(spark, [(1, "a b", "s", 0.0)]), "doc_id", "text", "source").collect()
    assert not few[0]["truncated"]


def test_limits_are_found_where_lengths_heap_up(spark):
    rows = [(i, "x" * (100 if i % 3 else 20 + i), "cut", 0.0) for i in range(60)] + [(i, "é" * (10 + 7 * i), "free", 0.0) for i in range(200)]
    got = {r["source"]: (r["limit_chars"], r["limit_bytes"]) for r in length_limits(frame(spark, rows), "text", "source").collect()}
    assert got["cut"] == (100, 100)
    assert length_limits(frame(spark, []), "text", "source").count() == 0


def test_pieces_of_the_features():
    assert line_kind("== See also ==") == "heading" and line_kind("* [[a]]") == "list" and line_kind("|-") == "table" and line_kind("Text") == "prose"
    assert gap_feature(100, None) == "none" and gap_feature(100, 100) == "0" and gap_feature(97, 100) == "4" and gap_feature(10, 100) == "far"
    assert features("abc", "none", "none") == features("abc", "none", "none")
    draw, text = np.random.default_rng(0), article(random.Random(1), 6)
    parts = [cut_short(text, draw) for _ in range(50)]
    assert all(p is None or p[-1] not in ".\n" or p.endswith("...") for p in parts) and any(parts)
    assert cut_short("short", draw) is None


def test_limits_below_the_greatest_length_count_too(spark):
    rows = [(i, "x" * (500 if i % 6 == 0 else 1200 if i % 6 == 1 else 40 + 9 * i), "mixed", 0.0) for i in range(300)] + [(300, "x" * 40_000, "mixed", 0.0)]
    rows += [(i, "x" * (30 + 5 * i), None, 0.0) for i in range(200)]
    got = {r["source"]: (r["limits_chars"], r["limits_bytes"]) for r in source_limits(frame(spark, rows), "text", "source").collect()}
    assert got["mixed"] == ([500, 1200], [500, 1200])
    assert gap_to(500, [500, 1200]) == "0" and gap_to(501, [500, 1200]) == "far" and gap_to(1190, [500, 1200]) == "16" and gap_to(3000, [500, 1200]) == "far" and gap_to(5, []) == "none"
    limit = length_limits(frame(spark, rows).where("source = 'mixed'"), "text", "source").first()
    assert (limit["limit_chars"], limit["limit_bytes"]) == (1200, 1200)


def test_open_markup_is_seen_over_the_whole_last_line():
    long = "word " * 900
    for opened, closed in (("(a b", "(a) b"), ("'''a b", "'''a''' b"), ("<ref a b", "<ref> a b")):
        assert features(long + opened + " of the old tower and the long bridge" * 9, "none", "none") != features(long + closed + " of the old tower and the long bridge" * 9, "none", "none")
    assert features("(a " + long + "b) end", "none", "none") == features("a " + long + "b) end", "none", "none")


def test_many_sources_are_joined_and_score_the_same(spark, monkeypatch):
    rows, _ = corpus(6, 250)
    rows += [(950, rows[0][1], None, 0.1), (951, None, "blank only", 0.1), (952, "", "blank only", 0.1)]
    key = lambda r: (r["id"], r["source"] or "", round(r["score"], 4))
    one = sorted(map(key, truncation_scores(frame(spark, rows), "doc_id", "text", "source").collect()))
    monkeypatch.setattr(module, "MAX_SOURCES", 1)
    assert sorted(map(key, truncation_scores(frame(spark, rows), "doc_id", "text", "source").collect())) == one and len(one) == len(rows)


def test_the_sample_is_bounded_however_often_a_record_is_repeated(spark):
    rows, _ = corpus(7, 120)
    prepared = module._Prepared(frame(spark, rows + rows[:1] * 4000), "doc_id", "text", "source")
    assert prepared.total == 4120
    got = module.fit(prepared, 4000)
    few = module._Prepared(frame(spark, rows), "doc_id", "text", "source")
    few.known = prepared.known
    assert (got != 0).any() and np.allclose(got, module.fit(few, 4000), atol=1e-9)
