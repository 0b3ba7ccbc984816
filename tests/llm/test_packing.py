import random

import pytest

from skewloom.llm.packing import TOKENIZERS, Windows, oversized, pack, pieces, token_counter, token_sizes

STEM = f"{TOKENIZERS}/byte_bpe_50k"


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, size bigint, container string")


def check(rows, packed, capacity):
    want = {}
    for i, size, _ in rows:
        if size and size > 0:
            want.setdefault(i, []).append(size)
    by_container, by_item = {}, {}
    for r in packed:
        by_container.setdefault(r["container"], []).append(r)
        by_item.setdefault(r["id"], []).append(r["size"])
    for own in by_container.values():
        total = sum(r["size"] for r in own)
        assert total <= capacity and all(r["filled"] == total for r in own)
    assert {i: sum(s) for i, s in by_item.items()} == {i: sum(s) for i, s in want.items()}
    for i, s in by_item.items():
        assert len(s) == sum(-(-x // capacity) for x in want[i])  # only what exceeds a container is cut
    return len(by_container)


def best_fit_decreasing(sizes, capacity):
    room = []
    for size in sorted(sizes, reverse=True):
        fit = [k for k, r in enumerate(room) if r >= size]
        if fit:
            room[min(fit, key=lambda k: room[k])] -= size
        else:
            room.append(capacity - size)
    return len(room)


def test_packs_tightly_and_completely(spark):
    draw = random.Random(5)
    rows = [(i, draw.choice([draw.randint(1, 300), draw.randint(300, 999)]), "clash") for i in range(3000)]
    rows += [(5000, 2500, ""), (5001, 1000, ""), (5002, 0, ""), (5003, None, ""), (5004, 2000, "")]
    n = check(rows, pack(frame(spark, rows).repartition(6), 1000, 32).collect(), 1000)
    assert n <= 1.03 * best_fit_decreasing([x for r in rows for _, _, x in pieces([0], [r[1] or 0], 1000)], 1000) + 1


def test_oversized_items(spark):
    rows = [(1, 1001, ""), (2, 1000, ""), (3, 5000, ""), (4, 1, "")]
    assert sorted(r[0] for r in oversized(pack(frame(spark, rows), 1000)).collect()) == [1, 3]


def test_repeated_ids_and_ties(spark):
    rows = [(1, 400, "")] * 7
    assert check(rows, pack(frame(spark, rows), 1000).collect(), 1000) == 4


def test_empty(spark):
    assert pack(frame(spark, [])).count() == 0


def test_pieces():
    assert list(pieces([1, 2, 3], [10, 4, 0], 4)) == [(1, 0, 4), (1, 1, 4), (1, 2, 2), (2, 0, 4)]


def test_window_space_is_bounded_and_best_fit():
    w, out = Windows(10, 2), []
    for i, size in enumerate([6, 5, 4, 3, 9]):
        out += list(w.add(i, size))
        assert len(w.held) <= 2
    assert out[0] == [0, 2]  # 4 fills the window with 6 exactly


def test_sizes_are_those_of_the_tokenizer(spark):
    pytest.importorskip("tiktoken")
    texts = ["", None, "Hello world, <|endoftext|> ünïcode", "a" * 50_000, " " * 60_000, "one\n" * 9_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["id"]: r["size"] for r in token_sizes(df, "doc_id", "text", STEM).collect()}
    assert got[0] == got[1] == 0 and got[3] > 1000 and got[4] > 0
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(f"{STEM}.json")
    slow.encode_special_tokens = True
    for i in (2, 3, 5):
        assert got[i] == len(slow.encode(texts[i], add_special_tokens=False).ids)
    assert token_counter(STEM)(["Hello"]) == [1]


@pytest.mark.parametrize("text", [
    "The mill of Davi was built in 1712; it's still there, isn't it?", "Ünïcödé — “quotes” … naïve façade", "Москва и Санкт-Петербург, 1999 г.", "東京は日本の首都です。人口は1400万人",
    "مدينة القاهرة 2024", "नमस्ते दुनिया", "emoji 👩‍👩‍👧 🇫🇷 ✅", "tabs\tand\r\nlines\n\n\n   of   space ", "{{Infobox|a=1}} [[Category:X]] <ref name=\"y\">z</ref>", "a" * 5000, "é ​ zero width",
])
@pytest.mark.parametrize("name", ["byte_bpe_50k"])
def test_both_libraries_count_the_same_tokens(text, name, monkeypatch):
    from skewloom.llm import packing

    packing.token_counter.cache_clear()
    fast = token_counter(f"{TOKENIZERS}/{name}")([text])
    monkeypatch.setattr(packing, "LONG_SPACE", packing.re.compile(""))  # every text takes the other way
    packing.token_counter.cache_clear()
    assert packing.token_counter(f"{TOKENIZERS}/{name}")([text]) == fast
    packing.token_counter.cache_clear()
