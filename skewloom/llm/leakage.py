"""Evaluation passages inside training text, by a distributed positional inverted index.

The index is cut into segments of documents: a segment holds, for each term, the sorted
(document, position) postings of its own documents, and one row of the stored table is one segment.
A search reads the terms' document frequencies over all segments, takes from each passage the rarest
terms so that every run of ``words`` terms contains one, turns their postings into alignments (the
position at which the passage would begin), and intersects the offset-adjusted postings of the other
terms with those alignments. The longest run of hits in an alignment is an exact phrase; hits within
``slack`` positions give proximity matches.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written

#: Characters of passages that one search sends to every task; more are searched in blocks.
BLOCK_CHARS = 4_000_000
#: Postings and documents of a segment.
SEGMENT_POSTINGS, SEGMENT_DOCS = 1_000_000, 4096
#: Query terms that a join may broadcast.
MAX_BROADCAST_TERMS = 200_000
_SHIFT = 32

_REF = re.compile(r"<ref\b[^<>]*?(?:/>|>(.*?)</ref\s*>)", re.I | re.S)
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]")
_URL = re.compile(r"\[(?:https?:)?//[^\s\]]+\s*([^\]]*)\]")
_TEMPLATE = re.compile(r"\{\{\s*[^{}|=]*\||\}\}")
_INLINE = re.compile(r"</?(?:b|i|u|em|strong|span|small|big|sup|sub|font|nowiki|mark|s|tt|code)\b[^<>]*>|'{2,}|[­​-‏⁠﻿]", re.I)
_TAG = re.compile(r"<[^<>]*>")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """A text's words in order, without case, punctuation, entities and markup; footnotes follow the text."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<" in text:
        text = _COMMENT.sub(" ", text)
        notes = [m[1] for m in _REF.finditer(text) if m[1]]
        text = " ".join([_REF.sub(" ", text), *notes])
    if "[" in text:
        text = _URL.sub(r"\1", _LINK.sub(r"\1", text))
    if "{{" in text:
        text = _TEMPLATE.sub(" ", text)
    text = _TAG.sub(" ", _INLINE.sub("", text))
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(text.lower())


def build_index(docs: DataFrame, id_col: str, text_col: str, vocabulary: set[str] | None = None) -> DataFrame:
    """Stores the postings of all documents and gives the table, one row per segment.

    Columns: ``docs`` (ids), ``terms``, ``ends`` (where each term's postings end) and the postings
    ``doc`` (place in ``docs``) and ``pos``. A ``vocabulary`` keeps only the postings of its terms,
    which is all that a search for known passages reads. Null ids and texts are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seg = _Segment()
        for b in batches:
            for i, text in zip(b["id"], b["text"]):
                seg.add(i, words(text), vocabulary)
                if seg.size >= SEGMENT_POSTINGS or len(seg.docs) >= SEGMENT_DOCS:
                    yield seg.row()
                    seg = _Segment()
        if seg.docs:
            yield seg.row()

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropna()
    return written(rows.mapInPandas(run, f"docs array<{kind}>, terms array<string>, df array<int>, ends array<int>, doc array<int>, pos array<int>"))


class _Segment:
    def __init__(self):
        self.docs, self.ids, self.size = [], {}, 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, doc, tokens: list[str], vocabulary: set[str] | None) -> None:
        ids = self.ids
        if vocabulary is None:
            at = np.fromiter((ids.setdefault(t, len(ids)) for t in tokens), dtype=np.int32, count=len(tokens))
            pos = np.arange(len(at), dtype=np.int32)
        else:
            at = np.fromiter((ids.setdefault(t, len(ids)) if t in vocabulary else -1 for t in tokens), dtype=np.int32, count=len(tokens))
            pos = np.flatnonzero(at >= 0).astype(np.int32)
            at = at[pos]
        self.docs.append(doc)
        self.parts.append((at, pos))
        self.size += len(at)

    def row(self) -> pd.DataFrame:
        term = np.concatenate([p[0] for p in self.parts])
        pos = np.concatenate([p[1] for p in self.parts])
        doc = np.repeat(np.arange(len(self.docs), dtype=np.int32), [len(p[0]) for p in self.parts])
        order = np.argsort(term, kind="stable")  # documents and positions stay ascending within a term
        term, doc, pos = term[order], doc[order], pos[order]
        ends = np.searchsorted(term, np.arange(len(self.ids)), side="right").astype(np.int32)
        new = np.r_[True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])] if len(term) else np.zeros(0, dtype=bool)
        df = np.bincount(term[new], minlength=len(self.ids)).astype(np.int32)
        return pd.DataFrame({"docs": [self.docs], "terms": [list(self.ids)], "df": [df], "ends": [ends], "doc": [doc], "pos": [pos]})


def document_frequencies(index: DataFrame, of: set[str]) -> dict[str, int]:
    """Documents of the whole collection that hold each of the given terms."""
    each = index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select("x.terms", "x.df")
    total = each.groupBy("terms").agg(F.sum("df").alias("df"))
    asked = index.sparkSession.createDataFrame([(t,) for t in of], "terms string")  # terms of one block of passages
    total = total.join(F.broadcast(asked) if len(of) < MAX_BROADCAST_TERMS else asked, "terms", "left_semi")
    return {r[0]: r[1] for r in total.collect()}


def anchors(passage: list[str], n: int, df: dict[str, int], each: int = 1) -> list[int]:
    """Positions of the rarest terms such that every run of ``n`` terms holds ``each`` of them."""
    rarity = [df.get(t, 0) for t in passage]
    out: list[int] = []
    for s in range(len(passage) - n + 1):
        inside = [p for p in out if p >= s]
        free = sorted((p for p in range(s, s + n) if p not in inside), key=lambda p: (rarity[p], -p))
        out += free[: max(0, each - len(inside))]
    return sorted(out)


def search(index: DataFrame, passages: list[tuple], n: int, item_kind: str = "bigint", slack: int = 3, near_share: float = 0.9) -> DataFrame:
    """(doc, item, match, words, start) of every passage in every document of the index.

    ``match`` is 'exact' where ``words`` >= ``n`` consecutive words of the passage stand in the text
    at word ``start``, and else 'proximity' where of some ``n`` consecutive words of the passage at
    least ``near_share``, among them one of the two rarest, stand within ``slack`` places of where they
    belong. The best match of a pair is given.
    """
    tokens = [(item, words(text)) for item, text in passages]
    df = document_frequencies(index, {t for _, p in tokens for t in p})
    spare = int(n - near_share * n + 1e-9)  # words of a run that a near match may miss
    wanted = [(item, p, anchors(p, n, df, each=2), anchors(p, n, df, each=2 * spare + 2)) for item, p in tokens if len(p) >= n]
    doc_kind = index.schema["docs"].dataType.elementType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                found = list(_search_segment(r, wanted, n, slack, near_share))
                if found:
                    yield pd.DataFrame(found, columns=["doc", "item", "match", "words", "start"])

    return index.mapInPandas(run, f"doc {doc_kind}, item {item_kind}, match string, words int, start int")


def _search_segment(r, wanted: list[tuple], n: int, slack: int, near_share: float) -> Iterator[tuple]:
    keys = (np.asarray(r.doc, dtype=np.int64) << _SHIFT) + np.asarray(r.pos, dtype=np.int64)
    ends = np.asarray(r.ends)
    place = {t: k for k, t in enumerate(r.terms)}
    none = np.zeros(0, dtype=np.int64)

    def postings(term: str) -> np.ndarray:
        k = place.get(term)
        return none if k is None else keys[(ends[k - 1] if k else 0) : ends[k]]

    spare = int(n - near_share * n + 1e-9)
    for item, passage, anchor, rare in wanted:
        base = len(passage)  # keeps alignments before a text's first word apart from the document before it
        begins = [postings(passage[p]) + (base - p) for p in anchor if passage[p] in place]
        if not begins or not sum(map(len, begins)):
            continue
        start = np.unique(np.concatenate(begins))
        best: dict[int, tuple] = {}
        own = [postings(t) + base for t in passage]
        for chunk in np.array_split(start, max(1, len(start) * len(passage) // 4_000_000)):
            hit = np.stack([_among(chunk + q, own[q], 0) for q in range(len(passage))], axis=1)
            run, at = _longest_run(hit)
            near = np.zeros_like(run)
            # A near match misses at most ``spare`` words of its run, so also at most ``spare`` of the run's rare ones.
            seen = np.zeros((len(chunk), len(passage) + 1), dtype=np.int16)
            inside = np.zeros(len(passage) + 1, dtype=np.int16)
            for q in rare:
                seen[:, q + 1] = _among(chunk + q, own[q], slack)
                inside[q + 1] = 1
            seen, inside = np.cumsum(seen, axis=1, dtype=np.int16), np.cumsum(inside)
            enough = (seen[:, n:] - seen[:, :-n] >= inside[n:] - inside[:-n] - spare).any(axis=1)
            weak = np.flatnonzero((run < n) & enough)
            if len(weak):
                soft = np.stack([_among(chunk[weak] + q, own[q], slack) for q in range(len(passage))], axis=1)
                total = np.cumsum(np.c_[np.zeros(len(weak), dtype=int), soft], axis=1)
                near[weak] = (total[:, n:] - total[:, :-n]).max(axis=1)
            for k in np.flatnonzero((run >= n) | (near >= near_share * n)):
                doc, position = int(chunk[k] >> _SHIFT), int((chunk[k] & ((1 << _SHIFT) - 1)) - base)
                exact = run[k] >= n
                this = (exact, int(run[k] if exact else near[k]), -(max(position, 0) + (int(at[k]) if exact else 0)))
                if doc not in best or this > best[doc]:
                    best[doc] = this
        for doc, (exact, size, at) in best.items():
            yield r.docs[doc], item, "exact" if exact else "proximity", size, -at


def _among(values: np.ndarray, sorted_keys: np.ndarray, slack: int) -> np.ndarray:
    """Whether some key lies within ``slack`` of each value."""
    if not len(sorted_keys):
        return np.zeros(len(values), dtype=bool)
    k = np.searchsorted(sorted_keys, values - slack)
    return (k < len(sorted_keys)) & (sorted_keys[np.minimum(k, len(sorted_keys) - 1)] <= values + slack)


def _longest_run(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length and begin of the longest run of hits in each row."""
    best, at, now = (np.zeros(len(hit), dtype=np.int64) for _ in range(3))
    for q in range(hit.shape[1]):
        now = np.where(hit[:, q], now + 1, 0)
        more = now > best
        best, at = np.where(more, now, best), np.where(more, q - now + 1, at)
    return best, at


def find_passages(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, passage_col: str, n: int = 10, **how) -> DataFrame:
    """(doc, item, match, words, start) for all documents against all items, by index and search.

    The passages are the query set: up to ``BLOCK_CHARS`` characters of them go to every task, a larger
    set is searched in blocks over the same index. Passages under ``n`` words cannot match. Null ids,
    texts and passages are left out; repeated items count once per id and text.
    """
    asked = items.select(F.col(item_col).alias("item"), F.col(passage_col).alias("text")).dropna().distinct()
    size = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(size // BLOCK_CHARS) + 1
    part = lambda k: sorted(tuple(r) for r in asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect())
    how["item_kind"] = asked.schema["item"].dataType.simpleString()
    if blocks == 1:
        passages = part(0)
        index = build_index(docs, id_col, text_col, {t for _, text in passages for t in words(text)})
        return search(index, passages, n, **how)
    index = build_index(docs, id_col, text_col)
    return reduce(DataFrame.unionByName, (search(index, part(k), n, **how) for k in range(blocks)))
