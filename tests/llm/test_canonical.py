import random

import pytest

from skewloom.llm import canonical as module
from skewloom.llm.canonical import Matcher, Matching, Near, counted, map_values
from skewloom.llm.vocabulary import ALIASES, FILLERS, SIZE_BINS

HOW = Matching(aliases=ALIASES, bins=SIZE_BINS, fillers=FILLERS)
ORGANISMS = [(1, "Human"), (2, "Mouse/Rat"), (3, "Zebrafish"), (4, "Drosophila melanogaster"), (9, "Plant"), (17, "Other"), (40, "Kelhel davelis"), (41, "Kelhel ornelwenis"), (42, "Tarocor davelis")]
AREAS = [(1, "Ecology"), (2, "Microbiology"), (3, "Marine Microbiology"), (4, "Plant Biology"), (5, "Plant Pathology"), (6, "Pathology"), (7, "Cell Biology")]
SIZES = [(1, "Single Subject / Case Study"), (2, "Small Cohort (<50 subjects)"), (3, "Medium Cohort (50-1000 subjects)"), (4, "Large Cohort / Population-scale (>1000 subjects)")]


@pytest.mark.parametrize(("attr", "entries", "value", "want"), [
    ("model_organism", ORGANISMS, "homo sapiens", 1),
    ("model_organism", ORGANISMS, "adult human (wild type)", 1),
    ("model_organism", ORGANISMS, "hümann", 1),
    ("model_organism", ORGANISMS, "mousé/rt", 2),
    ("model_organism", ORGANISMS, "rat and mouse", 2),
    ("model_organism", ORGANISMS, "d. melanogaster", 4),
    ("model_organism", ORGANISMS, "k. davelis", 40),
    ("model_organism", ORGANISMS, "davelis (tarocor)", 42),
    ("model_organism", ORGANISMS, "kel_ornelwenis", 41),
    ("model_organism", ORGANISMS, "kelhelornelwenis", 41),
    ("model_organism", ORGANISMS, "ticket 4471", -1),
    ("model_organism", ORGANISMS, "???", -1),
    ("primary_research_area", AREAS, "biology, plant", 4),
    ("primary_research_area", AREAS, "pathology, plant", 5),
    ("primary_research_area", AREAS, "applied marine microbiology", 3),
    ("primary_research_area", AREAS, "dept. of ecology", 1),
    ("primary_research_area", AREAS, "micrbiolgy", 2),
    ("primary_research_area", AREAS, "furniture design", -1),
    ("sample_size", SIZES, "n = 1", 1),
    ("sample_size", SIZES, "36 subjects", 2),
    ("sample_size", SIZES, "n=1000", 3),
    ("sample_size", SIZES, "about 28,899 people enrolled", 4),
    ("sample_size", SIZES, "row 17", -1),
    ("sample_size", SIZES, "under 50", 2),
])
def test_single_values(attr, entries, value, want):
    assert Matcher(attr, entries, HOW).find(value)[0] == want


def test_counts_need_a_unit():
    assert counted("12") is None and counted("n of 12") == 12 and counted("ticket 12 patients") is None


def test_an_ambiguous_abbreviation_is_not_guessed():
    m = Matcher("model_organism", [(1, "Kelhel davelis"), (2, "Korda davelis")], HOW)
    assert m.find("k. davelis")[0] == -1


def test_table(spark):
    rows = [(1, "Human; hüman", "clash"), (1, "Human; hüman", "clash"), (2, None, ""), (3, " ; ", ""), (4, "gibberish qqq", ""), (None, "hüman", ""), (5, "x" * 30_000, "")]
    df = spark.createDataFrame(rows, "row_id bigint, model_organism string, term string")
    ref = spark.createDataFrame([(i, "model_organism", v) for i, v in ORGANISMS] + [(99, "model_organism", "human"), (None, "model_organism", "q"), (5, None, "z")], "ref_id bigint, attr string, ref_value string")
    got = {(r["row_id"], r["term"]): r["ref_id"] for r in map_values(df, "row_id", ["model_organism"], ref, HOW).collect()}
    assert got == {(1, "hüman"): 1, (None, "hüman"): 1, (4, "gibberish qqq"): -1, (5, "x" * 30_000): -1}


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "abc")], "row_id bigint, model_organism string")
    ref = spark.createDataFrame([], "ref_id bigint, attr string, ref_value string")
    assert [tuple(r) for r in map_values(df, "row_id", ["model_organism"], ref, HOW).collect()] == [(1, "model_organism", "abc", -1, "unmatched")]
    assert map_values(df.limit(0), "row_id", ["model_organism"], ref, HOW).count() == 0


SYLLABLES = ["ka", "lo", "mer", "tin", "sol", "dav", "ra", "bel", "nor"]


def made_up(draw, n):
    word = lambda: "".join(draw.choice(SYLLABLES) for _ in range(draw.randint(1, 4)))
    return [" ".join(word() for _ in range(draw.randint(1, 3))) for _ in range(n)]


def typo(draw, word):
    for _ in range(draw.randint(1, 4)):
        k = draw.randrange(len(word) + 1)
        word = draw.choice([word[:k] + word[k + 1 :], word[:k] + draw.choice("aeqx") + word[k:], word[: max(k - 1, 0)] + word[k : k + 1] + word[max(k - 1, 0) : k] + word[k + 1 :]])
    return word


@pytest.mark.parametrize("slack", [0.25, 0.26, 0.4])
def test_candidates_lose_no_word_within_the_slack(slack):
    draw = random.Random(3)
    words = sorted({w.replace(" ", "") for w in made_up(draw, 500)})
    near = Near(words, slack)
    for value in (typo(draw, draw.choice(words)) for _ in range(150)):
        got = set(near.near(value)[0].tolist())
        for k, w in enumerate(words):
            if value and module._edit_similarity(value, w, 1 - slack) >= 1 - slack and max(len(value), len(w)) * slack >= 1:
                assert k in got, (value, w)


def test_indexed_similarity_equals_the_search_of_the_whole_list():
    draw = random.Random(4)
    entries = sorted((i, n.capitalize()) for i, n in enumerate(sorted(set(made_up(draw, 250)))))
    p = Matcher("x", entries, Matching()).patterns
    for value in (module.fold(typo(draw, draw.choice(entries)[1].lower())) for _ in range(150)):
        if not value:
            continue
        best, whole = {}, {}
        for name, i in p.squashed.items():
            if len(name) >= 4 and (s := module._edit_similarity(value.replace(" ", ""), name, 0.74)) >= 0.74:
                whole[i] = max(whole.get(i, 0), s)
        for name, i in ((w, i) for i, w in p.rows):
            if (s := module._token_set(value.split(), name)) >= 0.74:
                best[i] = max(best.get(i, 0), s)
        assert p.alike(value) == module._top(whole) and (p.token_sets(value) == module._top(best) or (not best and p.token_sets(value)[0] < 0.74)), value


def test_a_list_in_blocks_gives_the_same(spark, monkeypatch):
    draw = random.Random(5)
    names = [n.capitalize() for n in made_up(draw, 120)]
    known = [(i, "model_organism", n) for i, n in enumerate(names)] + [(500 + i, "model_organism", v) for i, v in ORGANISMS] + [(900 + i, "sample_size", v) for i, v in SIZES] + [(77, "model_organism", names[3].upper())]
    ref = spark.createDataFrame(known, "ref_id bigint, attr string, ref_value string")
    values = [typo(draw, draw.choice(names).lower()) for _ in range(80)] + ["homo sapiens", "rat and mouse", "k. davelis", "davelis (tarocor)", "???", "adult human (wild type)", "qqq"]
    rows = [(i, v, draw.choice(["n = 12", "36 subjects", "row 17", "under 50", "2000 people", None])) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "row_id bigint, model_organism string, sample_size string")
    found = lambda: sorted((r["row_id"], r["attr"], r["term"], r["ref_id"], r["found_by"]) for r in map_values(df, "row_id", ["model_organism", "sample_size"], ref, HOW).collect())
    one = found()
    for name, most in (("MAX_ENTRIES", 10), ("BLOCK_FORMS", 400), ("BLOCK_VALUES", 30)):
        monkeypatch.setattr(module, name, most)
    assert found() == one and len({r[4] for r in one}) == 5
