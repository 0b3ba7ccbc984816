"""Mapping of freely typed values to a reference list.

Steps for every distinct value: a whole name, alias or generated form counts as such; a count with a unit is
placed by numeric bins; a multi-pattern automaton over all forms finds mentions inside the value, and the longest of the
non-overlapping ones wins if it makes up most of the value; what is left is compared by token-set similarity whose
tokens may differ by typing errors, and takes a short mention where nothing is similar. Below the threshold, or where two
entries tie, the value is reported as unmatched. Similar names are looked up by shared pairs of letters or by deletions,
which lose none above the threshold, so a value is never compared with the whole list. A list too large for a task is cut
into blocks of forms; every block gives its evidence for a value, and the merged evidence decides as one list would.
"""

from __future__ import annotations

import json
import operator
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .common import join_unique, terms

#: Entries of a reference list that are sent to every task, some 10 MB; a larger list is cut into blocks.
MAX_ENTRIES = 50_000
#: Forms of a block, and values that meet it in one task.
BLOCK_FORMS, BLOCK_VALUES = 200_000, 20_000


@dataclass(frozen=True)
class Matching:
    """Parameters of the matching.

    ``aliases``: attribute -> canonical value -> other names. ``bins``: attribute -> (least, most,
    canonical value) for counts. ``fillers``: words that carry no meaning of their own.
    ``min_similarity``: least token-set similarity. ``min_mention``: letters an embedded mention needs.
    """

    aliases: Mapping[str, Mapping[str, Sequence[str]]] = field(default_factory=dict)
    bins: Mapping[str, Sequence[tuple[int, float, str]]] = field(default_factory=dict)
    fillers: frozenset[str] = frozenset()
    min_similarity: float = 0.74
    min_mention: int = 3


def fold(text: str) -> str:
    """Lower case without accents; every run of anything but letters, digits, < and > is one space."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return " ".join(re.findall(r"[^\W_]+|[<>]", bare))


_COUNT = re.compile(
    r"(?:n\s*(?:=|of)?\s*|(?:about|approx\w*|around|circa|over|total of|~)\s*)*(\d[\d,. ]*)\s*"
    r"(subjects?|patients?|participants?|people|persons?|individuals?|volunteers?|cases?|donors?)?\b.*"
)


def counted(text: str) -> int | None:
    """The number in a count such as 'n = 12', '12 patients' or 'about 710 people enrolled'."""
    t = text.lower().strip(" .*")
    m = _COUNT.fullmatch(t)
    if not m or not (m[2] or re.match(r"n\s*(=|of)", t)):
        return None
    digits = re.sub(r"\D", "", m[1])
    return int(digits) if digits else None


def forms(attr: str, entries: Sequence[tuple[int, str]], how: Matching) -> Iterator[tuple[str, int, bool]]:
    """(form, entry, whether it is the entry's whole name) of all ways to write the entries; aliases name the smallest of equal entries."""
    least: dict[str, int] = {}
    for i, value in entries:
        low = value.lower()
        least[low] = min(i, least.get(low, i))
        yield fold(value), i, True
        yield from ((other, i, False) for other in _forms(value))
    for value, others in how.aliases.get(attr, {}).items():
        if (i := least.get(value.lower())) is not None:
            yield from ((fold(other), i, False) for other in others)


def spoken(attr: str, entries: Sequence[tuple[int, str]], how: Matching) -> Iterator[tuple[str, int]]:
    """(name, entry) of the names and aliases that token sets are made of."""
    least: dict[str, int] = {}
    for i, value in entries:
        least[value.lower()] = min(i, least.get(value.lower(), i))
        yield fold(value), i
    for value, others in how.aliases.get(attr, {}).items():
        if (i := least.get(value.lower())) is not None:
            yield from ((fold(other), i) for other in others)


def settled(pairs: Iterator[tuple[str, int, bool]]) -> dict[str, int]:
    """form -> entry. A form that several entries share names none of them, unless it is a whole name: then the smallest that has it."""
    own: dict[str, set[int]] = {}
    full: dict[str, int] = {}
    for form, i, whole in pairs:
        if form:
            own.setdefault(form, set()).add(i)
            if whole:
                full[form] = min(i, full.get(form, i))
    return {form: full.get(form, min(ids)) for form, ids in own.items() if len(ids) == 1 or form in full}


class Near:
    """Words by edit distance: every word within ``slack`` of the longer length is among the candidates.

    A distance of 1 is found by leaving out one letter on either side. For d above 1 the words share at least length - 1 - 3 d
    pairs of letters, as an edit (a swap of neighbours at worst) breaks at most three of the longer word's.
    """

    def __init__(self, words: Sequence[str], slack: float):
        self.words, self.slack = words, slack
        self.size = np.array([len(w) for w in words], dtype=np.int64)
        self.bags = np.array([_bag(w) for w in words], dtype=np.int32).reshape(len(words), 37)
        self.one: dict[str, list[int]] = {}
        self.pairs: dict[str, list[int] | np.ndarray] = {}
        for k, w in enumerate(words):
            if self.allowed(len(w)) <= 1:
                for v in _deletions(w):
                    self.one.setdefault(v, []).append(k)
            for g in _pairs_of(w):
                self.pairs.setdefault(g, []).append(k)

    def allowed(self, n: int) -> int:
        return int(self.slack * n + 1e-9)

    def near(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """(places, least distances) of the candidates, the most alike by letters first."""
        m = len(word)
        if self.slack > 0.3:  # too few shared pairs to go by
            at = np.arange(len(self.words))
        else:
            lists = []
            for g in _pairs_of(word):
                if (own := self.pairs.get(g)) is not None:
                    if isinstance(own, list):
                        own = self.pairs[g] = np.array(own, dtype=np.int32)
                    lists.append(own)
            at = np.zeros(0, dtype=np.int64)
            if lists:
                count = np.bincount(np.concatenate(lists), minlength=len(self.words))
                at = np.flatnonzero(count >= min(n - 1 - 3 * self.allowed(n) for n in range(m, int(m / (1 - self.slack)) + 2)))
                most = np.maximum(self.size[at], m)
                d = (self.slack * most + 1e-9).astype(np.int64)
                at = at[(count[at] >= most - 1 - 3 * d) & (d > 1)]
            if self.allowed(m) <= 1 and (one := {k for v in _deletions(word) for k in self.one.get(v, ())}):
                at = np.union1d(at, sorted(one))
        # Letters counted: the distance is at least half the sum of the differences, and the difference of the lengths.
        gap = np.abs(self.size[at] - m).astype(float)
        some = gap <= self.slack * np.maximum(self.size[at], m) + 1e-9
        at, gap = at[some], gap[some]
        gap = np.maximum(np.abs(self.bags[at] - _bag(word)).sum(axis=1) / 2, gap)
        some = np.flatnonzero(gap <= self.slack * np.maximum(self.size[at], m) + 1e-9)
        some = some[np.argsort(gap[some], kind="stable")]
        return at[some], gap[some]


def _deletions(word: str) -> set[str]:
    return {word, *(word[:k] + word[k + 1 :] for k in range(len(word)))}


def _pairs_of(word: str) -> list[str]:
    """Neighbouring letters; a pair that occurs again has its number."""
    seen: dict[str, int] = {}
    out = []
    for k in range(len(word) - 1):
        g = word[k : k + 2]
        n = seen[g] = seen.get(g, 0) + 1
        out.append(g if n == 1 else f"{g}{n}")
    return out


class Patterns:
    """Forms of one attribute's entries, settled, with what finds them in a value: all of a list's, or one block's."""

    def __init__(self, names: Mapping[str, int], squashed: Mapping[str, int], tokens: Sequence[tuple[str, int]], how: Matching):
        import ahocorasick

        self.how, self.names, self.squashed = how, names, squashed
        self.automaton = ahocorasick.Automaton()
        for n, i in names.items():
            if len(n.replace(" ", "")) >= how.min_mention:
                self.automaton.add_word(f" {n} ", (len(n), i))
        if len(self.automaton):
            self.automaton.make_automaton()
        long = [(n, i) for n, i in squashed.items() if len(n) >= 4]
        self.whole, self.whole_entry = Near([n for n, _ in long], 1 - how.min_similarity), [i for _, i in long]
        self.rows = [(i, tuple(dict.fromkeys(name.split()))) for name, i in dict.fromkeys(tokens)]
        of: dict[str, list[int]] = {}
        for k, (_, own) in enumerate(self.rows):
            for w in own:
                of.setdefault(w, []).append(k)
        self.words = sorted(of)
        self.place = {w: k for k, w in enumerate(self.words)}
        self.holders = [np.array(of[w]) for w in self.words]
        self.row_size = np.array([len(own) for _, own in self.rows], dtype=float)
        self.close = Near(self.words, 0.25)

    def exact(self, text: str) -> int | None:
        """The entry that the text names as a whole."""
        return self.names.get(text, self.squashed.get(text.replace(" ", "")))

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(length, begin, entry) of every form inside the text."""
        return [(n, end - n, i) for end, (n, i) in self.automaton.iter(f" {text} ")] if len(self.automaton) else []

    def alike(self, text: str) -> tuple[float, list[int]]:
        """The greatest similarity of a whole form, and the entries that have it."""
        squashed, top, best = text.replace(" ", ""), self.how.min_similarity, {}
        for k, gap in zip(*(x.tolist() for x in self.whole.near(squashed))):
            name = self.whole.words[k]
            if 1 - gap / max(len(name), len(squashed)) < top - 1e-9:
                continue
            s = _edit_similarity(squashed, name, top)
            if s >= top:
                i, top = self.whole_entry[k], s
                best[i] = max(best.get(i, 0.0), s)
        return _top(best)

    def token_sets(self, text: str) -> tuple[float, list[int]]:
        """The greatest token-set similarity from the threshold on, and the entries that have it."""
        words = list(dict.fromkeys(text.split()))
        bound = np.zeros(len(self.rows))
        for w in words:
            same = {self.place[w]: 1.0} if w in self.place else {}
            if len(w) >= 3:
                for k in range(bisect_left(self.words, w), len(self.words)):
                    if not self.words[k].startswith(w):
                        break
                    same[k] = max(same.get(k, 0.0), _token_similarity(w, self.words[k]))
            for k in self.close.near(w)[0].tolist():
                same[k] = max(same.get(k, 0.0), _token_similarity(w, self.words[k]))
            best = np.zeros(len(self.rows))
            for k, s in sorted(same.items(), key=lambda x: x[1]):
                best[self.holders[k]] = s
            bound += best
        bound = 2 * bound / (len(words) + self.row_size)
        some = np.flatnonzero(bound >= self.how.min_similarity - 1e-9)
        found: dict[int, float] = {}
        top = 0.0
        for k in some[np.argsort(-bound[some], kind="stable")]:
            if bound[k] < top - 1e-9:
                break
            i, own = self.rows[k]
            s = _token_set(words, own)
            top = max(top, s)
            found[i] = max(found.get(i, 0.0), s)
        return _top(found)


def _top(best: Mapping[int, float]) -> tuple[float, list[int]]:
    top = max(best.values(), default=0.0)
    return top, sorted(i for i, s in best.items() if s > top - 1e-9)


def bare(text: str, how: Matching) -> str:
    """The text without words that carry no meaning."""
    return " ".join(w for w in text.split() if w not in how.fillers)


def longest_first(hits: Sequence[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(length, entry) of non-overlapping mentions, the longest first, of equal ones the first."""
    taken, out = [], []
    for n, begin, i in sorted(hits, key=lambda h: (-h[0], h[1])):
        if all(begin >= e or begin + n <= b for b, e in taken):
            taken.append((begin, begin + n))
            out.append((n, i))
    return out


def decide(value: str, how: Matching, bins: Sequence[tuple], known) -> tuple[int, str]:
    """(entry or -1, how it was found) from the evidence of ``known``: ``Patterns``, or what the blocks of a list found."""
    text = fold(value)
    if not text:
        return -1, "unmatched"
    if (i := known.exact(text)) is not None:
        return i, "name"
    if bins and (n := counted(value)) is not None:
        return next((i for low, high, i in bins if low <= n <= high and i is not None), -1), "count"
    short = bare(text, how)
    texts = [text, short] if short and short != text else [text]
    if len(texts) > 1 and (i := known.exact(short)) is not None:
        return i, "name"
    found = longest_first(known.hits(text))
    best = {i for n, i in found if n == found[0][0]}
    if len(best) == 1 and found[0][0] >= 0.6 * len(text):
        return best.pop(), "mention"
    similar, entry = max(_similar(t, known) for t in texts)
    # A value that is close to a whole name beats a short name inside it.
    if found and similar >= 0.85 and entry not in best and found[0][0] < 0.6 * len(text):
        return entry, "similar"
    if len(best) == 1:
        return best.pop(), "mention"
    return (entry, "similar") if similar >= how.min_similarity else (-1, "unmatched")


def _similar(text: str, known) -> tuple[float, int]:
    """The greatest similarity and its entry; -1 where two entries tie."""
    top, ids = known.alike(text)
    if top < 0.85:
        more, others = known.token_sets(text)
        if more > top - 1e-9:
            ids = sorted({*others, *ids} if more < top + 1e-9 else set(others))
            top = max(top, more)
    return (top, ids[0]) if len(ids) == 1 else (0.0, -1)


class Matcher:
    """The patterns of one attribute's whole reference list."""

    def __init__(self, attr: str, entries: Sequence[tuple[int, str]], how: Matching):
        self.how, self.bins = how, bins_of(attr, entries, how)
        names = settled(forms(attr, entries, how))
        squashed = settled((f.replace(" ", ""), i, whole) for f, i, whole in forms(attr, entries, how))
        self.patterns = Patterns(names, squashed, list(spoken(attr, entries, how)), how)

    def find(self, value: str) -> tuple[int, str]:
        """(entry or -1, how it was found)."""
        return decide(value, self.how, self.bins, self.patterns)


def bins_of(attr: str, entries: Sequence[tuple[int, str]], how: Matching) -> list[tuple]:
    """(least, most, entry) of the attribute's numeric bins."""
    return [(low, high, min((i for i, v in entries if v.lower() == to.lower()), default=None)) for low, high, to in how.bins.get(attr, ())]


def _bag(word: str) -> np.ndarray:
    out = np.zeros(37, dtype=np.int32)
    for c in word:
        out[ord(c) - 97 if "a" <= c <= "z" else ord(c) - 22 if "0" <= c <= "9" else 36] += 1
    return out


def _forms(value: str) -> Iterator[str]:
    """Other ways to write a name: words rotated ('Biology, Plant'), the first abbreviated ('E. coli'), its parts."""
    words = fold(value).split()
    if 2 <= len(words) <= 4:
        for k in range(1, len(words)):
            yield " ".join(words[k:] + words[:k])
    if len(words) == 2 and value == value.capitalize():  # a binomial: only the genus has a capital
        genus, species = words
        for cut in range(1, len(genus)):
            yield f"{genus[:cut]} {species}"
        yield f"{genus} sp {species}"
        yield f"{genus} cf {species}"
    if "/" in value:
        parts = [fold(p) for p in value.split("/")]
        yield from (p for p in parts if len(p) > 2)
        yield " and ".join(parts)
        yield " ".join(reversed(parts))
    if "(" in value:
        yield fold(value.split("(")[0])
    if not words[-1:] or not words[-1].endswith("s"):
        yield " ".join([*words[:-1], words[-1] + "s"]) if words else ""


def _edit_similarity(a: str, b: str, least: float = 0.6) -> float:
    """1 - distance / length of the longer, with insert, delete, replace and swap of neighbours at 1; 0 if below ``least``."""
    if a == b:
        return 1.0
    m, n = len(a), len(b)
    most = max(m, n)
    allowed = int((1 - max(least, 0.6)) * most + 1e-9)
    if abs(m - n) > allowed:
        return 0.0
    before, row = None, list(range(n + 1))
    for i in range(1, m + 1):
        last, row = row, [i] + [most] * n
        for j in range(max(1, i - allowed), min(n, i + allowed) + 1):  # outside the band the distance is too large
            d = last[j - 1] + (a[i - 1] != b[j - 1])
            if last[j] < d:
                d = last[j] + 1
            if row[j - 1] < d:
                d = min(d, row[j - 1] + 1)
            if before and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before[j - 2] + 1)
            row[j] = d
        before = last
        if min(row) > allowed:
            return 0.0
    return 1 - row[n] / most if row[n] <= allowed else 0.0


@lru_cache(maxsize=100_000)
def _token_similarity(w: str, x: str) -> float:
    """Of two tokens: equal, an abbreviation, or a typing error apart."""
    if w == x:
        return 1.0
    if len(w) >= 3 and len(x) > len(w) and x.startswith(w):
        return 0.85
    if abs(len(w) - len(x)) <= 2 and min(len(w), len(x)) >= 4:
        return _edit_similarity(w, x, 0.75)
    return 0.0


def _token_set(words: Sequence[str], name: Sequence[str]) -> float:
    """Soft Dice coefficient of two token sets: tokens pair off by edit similarity of 0.75 or more, or as an abbreviation."""
    left, total = list(dict.fromkeys(name)), 0.0
    size = len(dict.fromkeys(words)) + len(left)
    if not left or size == 0:
        return 0.0
    for w in dict.fromkeys(words):
        best, at = 0.0, None
        for x in left:
            s = _token_similarity(w, x)
            if s > best:
                best, at = s, x
        if at is not None:
            left.remove(at)
            total += best
    return 2 * total / size


def _named(attr, found):
    return F.transform(found, lambda t: F.struct(attr.alias("attr"), t.alias("term")))


def map_values(df: DataFrame, id_col: str, columns: Sequence[str], reference: DataFrame, how: Matching) -> DataFrame:
    """(id, attr, term, ref_id, found_by) of every distinct typed term of a record that is no reference value.

    ``reference`` has (ref_id, attr, ref_value); equal values take the smallest id. ``ref_id`` is -1
    and ``found_by`` 'unmatched' where no entry is close enough. Only distinct terms are matched, so a
    term that a third of all records share is one row of work. Nulls and blank cells hold no term. A reference list of
    more than ``MAX_ENTRIES`` is matched in blocks, with the same result.
    """
    exact = reference.select("attr", F.lower("ref_value").alias("term")).dropna().distinct()
    cells = [_named(F.lit(c), F.array_distinct(terms(F.col(c)))) for c in columns]
    empty = F.array().cast("array<struct<attr:string,term:string>>")
    typed = df.select(F.col(id_col), F.explode(F.concat(*(F.coalesce(c, empty) for c in cells))).alias("t")).select(id_col, "t.*").distinct()
    entries = reference.where("ref_id is not null and attr is not null and ref_value is not null").select("attr", "ref_id", "ref_value")
    few = entries.limit(MAX_ENTRIES + 1).collect()
    small = len(few) <= MAX_ENTRIES
    open_ = written(typed.join(F.broadcast(exact) if small else exact, ["attr", "term"], "left_anti"))
    # Matching costs far more than a row's bytes suggest, so distinct terms are spread over all cores.
    tasks = max(2 * df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Partitioned by a hash of the key: by the key itself Spark would reuse and coalesce the shuffle of distinct().
    distinct = open_.select("attr", "term").distinct().repartition(tasks, F.xxhash64("attr", "term"))
    matched = _in_one(distinct, few, how) if small else _in_blocks(distinct, entries, how)
    counts = open_.groupBy("attr", "term").agg(F.count(F.lit(1)).alias("_n"))
    return join_unique(open_, matched, ["attr", "term"], counts).select(id_col, "attr", "term", "ref_id", "found_by")


_FOUND = "attr string, term string, ref_id bigint, found_by string"


def _in_one(distinct: DataFrame, entries: list, how: Matching) -> DataFrame:
    """(attr, term, ref_id, found_by) against a list that every task holds."""
    lists: dict[str, list[tuple[int, str]]] = {}
    for attr, i, value in sorted(entries):
        lists.setdefault(attr, []).append((i, value))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matchers: dict[str, Matcher] = {}
        for b in batches:
            got = []
            for attr, term in zip(b["attr"], b["term"]):
                if attr not in matchers:
                    matchers[attr] = Matcher(attr, lists.get(attr, []), how)
                got.append(matchers[attr].find(term))
            yield b.assign(ref_id=[int(g[0]) for g in got], found_by=[g[1] for g in got])

    return distinct.mapInPandas(match, _FOUND)


def _in_blocks(distinct: DataFrame, entries: DataFrame, how: Matching) -> DataFrame:
    """(attr, term, ref_id, found_by) against a list of any size.

    The list's forms are settled by aggregates and cut into blocks by hash; a block and a part of the values are one task, which
    gives the evidence of the block for each value. A value's evidence, a row per block, is merged and decides as in one list.
    """
    aliased = {(attr, value.lower()) for attr, own in how.aliases.items() for value in own}
    binned = {attr: sorted({to.lower() for _, _, to in own}) for attr, own in how.bins.items()}
    # Aliases and bins name values, and of equal values the smallest entry: entries that have some keep them, the others lose them.
    least = entries.groupBy("attr", F.lower("ref_value").alias("_v")).agg(F.min("ref_id").alias("_first"))
    ready = entries.withColumn("_v", F.lower("ref_value")).join(least, ["attr", "_v"])

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for attr, low, i, value, first in zip(b["attr"], b["_v"], b["ref_id"], b["ref_value"], b["_first"]):
                with_aliases = how if (attr, low) in aliased and i == first else Matching()
                every = list(forms(attr, [(i, value)], with_aliases))
                out += ((attr, "name", f, i, whole) for f, i, whole in every if f)
                out += ((attr, "squashed", f.replace(" ", ""), i, whole) for f, i, whole in every if f)
                out += ((attr, "token", f, i, True) for f, i in spoken(attr, [(i, value)], with_aliases))
            yield pd.DataFrame(out, columns=["attr", "kind", "form", "entry", "whole"])

    every = ready.select("attr", "_v", "ref_id", "ref_value", "_first").mapInPandas(spread, "attr string, kind string, form string, entry bigint, whole boolean")
    own = F.min(F.when(F.col("whole"), F.col("entry")))
    one = every.where("kind <> 'token'").groupBy("attr", "kind", "form").agg(F.min("entry").alias("_a"), F.max("entry").alias("_b"), own.alias("_w"))
    one = one.where("_a = _b or _w is not null").select("attr", "kind", "form", F.coalesce("_w", "_a").alias("entry"))
    table = written(one.unionByName(every.where("kind = 'token'").select("attr", "kind", "form", "entry").distinct()))
    blocks = max(1, -(-table.count() // BLOCK_FORMS))
    values = max(1, -(-distinct.count() // BLOCK_VALUES))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    known = table.withColumn("_b", F.pmod(F.xxhash64("form", "entry"), F.lit(blocks)).cast("int")).withColumn("_c", upto(values))
    asked = distinct.withColumn("_c", F.pmod(F.xxhash64("attr", "term"), F.lit(values)).cast("int")).withColumn("_b", upto(blocks))

    def evidence(terms_: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        for attr, part in terms_.groupby("attr"):
            mine = block[block["attr"] == attr]
            names, squashed = (dict(zip(x["form"], x["entry"].tolist())) for x in (mine[mine["kind"] == k] for k in ("name", "squashed")))
            tokens = mine[mine["kind"] == "token"]
            p = Patterns(names, squashed, list(zip(tokens["form"], tokens["entry"].tolist())), how)
            for term in part["term"]:
                text = fold(term)
                texts = [t for t in dict.fromkeys((text, bare(text, how))) if t]
                got = {t: [p.names.get(t), p.squashed.get(t.replace(" ", "")), p.hits(t), p.alike(t), p.token_sets(t)] for t in texts}
                out.append((attr, term, json.dumps(got)))
        return pd.DataFrame(out, columns=["attr", "term", "seen"])

    seen = asked.groupBy("_b", "_c").cogroup(known.groupBy("_b", "_c")).applyInPandas(evidence, "attr string, term string, seen string")
    bins = written(ready.where(reduce(operator.or_, ((F.col("attr") == a) & F.col("_v").isin(v) for a, v in binned.items()), F.lit(False))).where("ref_id = _first").select("attr", "ref_id", "ref_value"))
    placed = {attr: bins_of(attr, [(r["ref_id"], r["ref_value"]) for r in bins.where(F.col("attr") == attr).collect()], how) for attr in binned}  # values that bins name

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [decide(term, how, placed.get(attr, ()), Merged([json.loads(x) for x in seen])) for attr, term, seen in zip(b["attr"], b["term"], b["seen"])]
            yield pd.DataFrame({"attr": b["attr"], "term": b["term"], "ref_id": [int(g[0]) for g in got], "found_by": [g[1] for g in got]})

    return seen.groupBy("attr", "term").agg(F.collect_list("seen").alias("seen")).mapInPandas(settle, _FOUND)  # a row per block


class Merged:
    """What the blocks of a list found, as ``Patterns`` of the whole list would give it."""

    def __init__(self, seen: Sequence[Mapping[str, list]]):
        self.seen = seen

    def _each(self, text: str, k: int) -> list:
        return [x[text][k] for x in self.seen if text in x]

    def exact(self, text: str) -> int | None:
        return next((i for k in (0, 1) for i in self._each(text, k) if i is not None), None)

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        return [tuple(h) for own in self._each(text, 2) for h in own]

    def alike(self, text: str) -> tuple[float, list[int]]:
        return self._best(text, 3)

    def token_sets(self, text: str) -> tuple[float, list[int]]:
        return self._best(text, 4)

    def _best(self, text: str, k: int) -> tuple[float, list[int]]:
        best: dict[int, float] = {}
        for top, ids in self._each(text, k):
            best.update({i: max(top, best.get(i, 0.0)) for i in ids})
        return _top(best)
