"""Annotators, embedders and generators from outside, as injected Python functions."""

from __future__ import annotations

import operator
import random
import time
from array import array
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import lru_cache, reduce
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_prompt(options: Mapping[str, Sequence[str]], text: Column, instruction: str) -> Column:
    """The prompt that asks for one option per attribute as JSON."""
    schema = ", ".join(f'"{a}": "<{"|".join(o)}>"' for a, o in options.items())
    return F.concat(F.lit(f"{instruction}\nAnswer with JSON only: {{{schema}}}\n\nText:\n"), text)


def parse_labels(answer: Column, attributes: Sequence[str], strict: bool = False) -> Column:
    """A struct of labels from an answer that may be fenced; all null if it is no JSON, or with ``strict`` an error."""
    bare = F.trim(F.regexp_replace(answer, r"```(json)?", ""))
    return F.from_json(bare, ", ".join(f"`{a}` string" for a in attributes), {"mode": "FAILFAST"} if strict else {})


def in_vocabulary(labels: Column, options: Mapping[str, Sequence[str]]) -> Column:
    """The struct of labels with every label that is no option of its attribute as null."""
    return F.struct(*(F.when(labels[a].isin(list(o)), labels[a]).alias(a) for a, o in options.items()))


def answer_counts(df: DataFrame, labels: Sequence[str], by: Sequence[str] = (), error: str | None = None) -> DataFrame:
    """(by, answers, errors, unparsed, and the share of answers with each label): how well a service answered.

    An answer is unparsed if it has neither an error nor a label.
    """
    none = reduce(operator.and_, (F.col(a).isNull() for a in labels))
    failed = F.col(error).isNotNull() if error else F.lit(False)
    agg = [F.count(F.lit(1)).alias("answers"), F.count_if(failed).alias("errors"), F.count_if(none & ~failed).alias("unparsed")]
    agg += [F.avg(F.col(a).isNotNull().cast("double")).alias(a) for a in labels]
    return df.groupBy(*by).agg(*agg) if by else df.agg(*agg)


def model_tag(model: Column) -> Column:
    """The last part of a model's path or name."""
    return F.element_at(F.split(F.rtrim(model, F.lit("/")), "/"), -1)


def call_with_retries(call: Callable[[str], str], prompt: str, retries: int = 6, pause: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None]:
    """(answer, error): repeats with growing pauses of at most a minute; never raises."""
    error = None
    for attempt in range(retries):
        try:
            return call(prompt), None
        except Exception as e:  # noqa: BLE001 - any failure of a service is recorded
            error = f"{type(e).__name__}: {e}"
            if attempt + 1 < retries:
                pause(min(60, 2**attempt) + random.random())
    return None, error


def ask(df: DataFrame, prompt: str, call: Callable[[str], str], retries: int = 6) -> DataFrame:
    """Adds ``answer`` and ``error`` of the service for every row. Deduplicate and go through a cache first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [call_with_retries(call, p, retries) for p in b[prompt]]
            yield b.assign(answer=[g[0] for g in got], error=[g[1] for g in got])

    return df.mapInPandas(run, _schema(df, "answer string, error string"))


def map_batches(df: DataFrame, columns: str, function: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Adds ``columns`` (a DDL string) that a vectorised Python function computes per batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.concat([b.reset_index(drop=True), function(b).reset_index(drop=True)], axis=1)

    return df.mapInPandas(run, _schema(df, columns))


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), more])


@lru_cache(maxsize=1024)
def _shift(n: int):
    """Four tables of 256: the exclusive or of their entries for the bytes of crc32(a) is crc32(a + b) ^ crc32(b), where b has n bytes."""
    import zlib

    import numpy as np

    zeros = bytes(n)
    moved = np.array([zlib.crc32(zeros, 1 << i ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for i in range(32)], dtype=np.uint32)
    table = np.zeros((4, 256), dtype=np.uint32)
    for i, m in enumerate(moved):
        byte, bit = divmod(i, 8)
        table[byte, 1 << bit : 2 << bit] = table[byte, : 1 << bit] ^ m
    return table


#: Texts whose words are hashed together, and words that are remembered between them.
EMBED_TEXTS, EMBED_WORDS = 200, 50_000


def hashed_embedding(text: str = "text", size: int = 64) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """An offline stand-in for an embedder: signed hashes of words and word pairs, to length 1.

    A word is hashed once; the hash of a pair is put together from those of its words.
    """

    def embed(b: pd.DataFrame) -> pd.DataFrame:
        import zlib

        import numpy as np

        class Words(dict):
            """Number of a word; arrays have its hash, that of the word after a blank, and where the tables of the latter's length begin."""

            def __init__(self):
                self.alone, self.after, self.table, self.lengths, self.tables = array("I"), array("I"), array("q"), {}, np.zeros(0, dtype=np.uint32)

            def __missing__(self, w):
                e = b" " + w.encode()
                if len(e) not in self.lengths:
                    self.lengths[len(e)] = len(self.tables)
                    self.tables = np.concatenate([self.tables, _shift(len(e)).ravel()])
                self.alone.append(zlib.crc32(e[1:]))
                self.after.append(zlib.crc32(e))
                self.table.append(self.lengths[len(e)])
                self[w] = n = len(self)
                return n

        def places(h, of):
            """Place of a hash within the counts of its text, those of the positive sign after the others."""
            return of * (2 * size) + (h % np.uint32(size)).astype(np.int64) + np.where(h & np.uint32(0x80000000), size, 0)

        out, known, all_texts = np.zeros((len(b), size), dtype=np.float32), Words(), b[text].fillna("").tolist()
        for begin in range(0, len(b), EMBED_TEXTS):
            if len(known) > EMBED_WORDS:
                known = Words()
            split = [t.lower().split() for t in all_texts[begin : begin + EMBED_TEXTS]]
            of = np.repeat(np.arange(len(split)), [len(w) for w in split])
            w = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=len(of))
            alone, after, table = np.array(known.alone, dtype=np.uint32), np.array(known.after, dtype=np.uint32), np.array(known.table, dtype=np.int64)
            last = 1 + np.flatnonzero(of[1:] == of[:-1])
            h, at, pair = alone[w[last - 1]], table[w[last]], after[w[last]]
            for k in range(4):
                pair ^= known.tables[at + 256 * k + (h >> np.uint32(8 * k) & np.uint32(255))]
            c = np.bincount(np.concatenate([places(alone[w], of), places(pair, of[last])]), minlength=len(split) * 2 * size).reshape(-1, 2 * size)
            out[begin : begin + len(split)] = c[:, size:] - c[:, :size]
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return pd.DataFrame({"vector": list(out / np.where(n > 0, n, 1))})

    return embed
