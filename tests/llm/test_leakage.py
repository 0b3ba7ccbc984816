import random

import pytest

from skewloom.llm import leakage
from skewloom.llm.leakage import anchors, build_index, document_frequencies, find_passages, search, words

VOCAB = [f"w{i}" for i in range(30)]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, doc string, item string")


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, passage string")


def longest(doc, passage):
    d, p, best = words(doc), words(passage), 0
    for i in range(len(d)):
        for j in range(len(p)):
            k = 0
            while i + k < len(d) and j + k < len(p) and d[i + k] == p[j + k]:
                k += 1
            best = max(best, k)
    return best


def test_exact_matches_equal_brute_force(spark):
    draw = random.Random(4)
    passages = [(i, " ".join(draw.choices(VOCAB, k=draw.randint(4, 25)))) for i in range(12)]
    rows = []
    for i in range(120):
        text = draw.choices(VOCAB, k=draw.randint(0, 40))
        if i % 2:
            p = draw.choice(passages)[1].split()
            begin = draw.randint(0, len(p) - 1)
            text[len(text) // 2 : len(text) // 2] = p[begin : begin + draw.randint(3, 14)]
        rows.append((i, " ".join(text), "clash", "clash"))
    got = {(r["doc"], r["item"]): r["words"] for r in find_passages(docs(spark, rows), "doc_id", "text", items(spark, passages), "item_id", "passage", 6).where("match = 'exact'").collect()}
    want = {(i, k): n for i, t, *_ in rows for k, p in passages if (n := longest(t, p)) >= 6}
    assert got == want and len(want) > 20


@pytest.mark.parametrize("text", [
    "x ONE two&nbsp;three, '''four'''\n:  five [[Six]] [[a|seven]] <b>eig</b>ht {{nowrap|nine}} ten! y",
    "one<ref name=\"a\">note | text</ref> two <!-- hidden --> three four<br/>five six seven eight nine ten",
    "a <ref>{{cite|one two three four five six seven eight nine ten}}</ref> b",
    "one two three four five six [https://x.org/q seven] ei­ght n​ine &#116;en",
    "ｏｎｅ two three four five six seven eight nine ten",
])
def test_markup_case_and_entities_do_not_hide_a_passage(spark, text):
    passage = "One two three four five six seven eight nine ten"
    got = find_passages(docs(spark, [(1, text, "", "")]), "doc_id", "text", items(spark, [(5, passage)]), "item_id", "passage").collect()
    assert [(r["doc"], r["item"], r["match"], r["words"]) for r in got] == [(1, 5, "exact", 10)]


def test_nine_words_are_not_ten_but_near(spark):
    passage = "a1 a2 a3 a4 a5 a6 a7 a8 a9 a10 a11"
    rows = [(1, "a1 a2 a3 a4 a5 a6 a7 a8 a9 zz", "", ""), (2, "a1 a2 a3 a4 a5 zz a6 a7 a8 a9 a10 a11", "", ""), (3, "a11 a3 a7", "", "")]
    got = {r["doc"]: r["match"] for r in find_passages(docs(spark, rows), "doc_id", "text", items(spark, [(5, passage)]), "item_id", "passage").collect()}
    assert got == {1: "proximity", 2: "proximity"}


def test_nulls_blanks_repeats_long_texts_and_empty_tables(spark):
    passage = "p0 p1 p2 p3 p4 p5 p6 p7 p8 p9"
    rows = [(1, None, "", ""), (None, passage, "", ""), (2, "", "", ""), (3, "q " * 200_000 + passage, "", ""), (4, passage, "", ""), (4, passage, "", "")]
    wanted = items(spark, [(5, passage), (5, passage), (6, None), (None, passage), (7, "p0 p1"), (8, "")])
    got = sorted((r["doc"], r["item"], r["start"]) for r in find_passages(docs(spark, rows), "doc_id", "text", wanted, "item_id", "passage").collect())
    assert got == [(3, 5, 200_000), (4, 5, 0), (4, 5, 0)]
    assert find_passages(docs(spark, rows), "doc_id", "text", wanted.limit(0), "item_id", "passage").count() == 0
    assert find_passages(docs(spark, []), "doc_id", "text", wanted, "item_id", "passage").count() == 0


def test_blocks_of_passages_give_the_same(spark, monkeypatch):
    draw = random.Random(8)
    passages = [(i, " ".join(draw.choices(VOCAB, k=12))) for i in range(8)]
    rows = [(i, passages[i % 8][1] + " tail", "", "") for i in range(20)]
    args = (docs(spark, rows), "doc_id", "text", items(spark, passages), "item_id", "passage")
    one = sorted(tuple(r) for r in find_passages(*args).collect())
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 100)
    assert sorted(tuple(r) for r in find_passages(*args).collect()) == one


def test_a_stored_index_serves_any_passage(spark):
    index = build_index(docs(spark, [(1, "x a b c y", "", ""), (2, "a b", "", ""), (3, "b b b a", "", "")]), "doc_id", "text")
    assert document_frequencies(index, {"a", "b", "zz"}) == {"a": 3, "b": 3}
    got = search(index, [(9, "a b c")], 3).where("match = 'exact'").collect()
    assert [(r["doc"], r["start"]) for r in got] == [(1, 1)]


def test_every_run_has_a_rare_anchor():
    p = ["the", "rare", "the", "of", "the", "of", "the", "odd"]
    df = {"the": 100, "of": 90, "rare": 1, "odd": 2}
    at = anchors(p, 3, df)
    assert 1 in at and all(any(s <= a < s + 3 for a in at) for s in range(len(p) - 2))
    assert all(sum(s <= a < s + 3 for a in anchors(p, 3, df, 2)) >= 2 for s in range(len(p) - 2))


def nearest(doc, passage, n, df, slack, at):
    """Most words of a run of n within slack of an alignment that starts at one of the anchors."""
    best = 0
    for d in {i - q for q in at for i, w in enumerate(doc) if w == passage[q]}:
        soft = [passage[q] in doc[max(0, d + q - slack) : max(0, d + q + slack + 1)] for q in range(len(passage))]
        best = max(best, *(sum(soft[s : s + n]) for s in range(len(passage) - n + 1)))
    return best


def test_proximity_matches_equal_brute_force(spark):
    draw = random.Random(6)
    passages = [(i, " ".join(draw.sample([f"v{j}" for j in range(60)], draw.randint(10, 16)))) for i in range(10)]
    rows = [(0, " ".join([*(p := passages[0][1].split())[:4], "X", *p[4:7], "Y", *p[7:10]]), "", "")]
    for i in range(1, 150):
        text = []
        for w in draw.choice(passages)[1].split():
            text += [w] * (draw.random() > 0.08) + ["zz"] * (draw.random() < 0.25)
        if draw.random() < 0.3:
            k = draw.randrange(max(1, len(text) - 1))
            text[k : k + 2] = reversed(text[k : k + 2])
        rows.append((i, " ".join(draw.choices(VOCAB, k=3) + text + draw.choices(VOCAB, k=3)), "", ""))
    got = {(r["doc"], r["item"]): (r["match"], r["words"]) for r in find_passages(docs(spark, rows), "doc_id", "text", items(spark, passages), "item_id", "passage").collect()}
    df = {}
    for _, t, *_ in rows:
        for w in set(t.split()):
            df[w.lower()] = df.get(w.lower(), 0) + 1
    want = {}
    for i, t, *_ in rows:
        for k, p in passages:
            p = p.split()
            if (size := longest(t, " ".join(p))) >= 10:
                want[i, k] = ("exact", size)
            elif (size := nearest(t.lower().split(), p, 10, df, 3, anchors(p, 10, df, 2))) >= 9:
                want[i, k] = ("proximity", size)
    assert got == want and got[0, 0] == ("proximity", 10) and sum(m == "proximity" for m, _ in want.values()) > 40
