"""Text values that were cut before their end.

Intact values are cut artificially to get positives; a logistic regression over hashed features of
the closing characters, of open markup and of the distance to the source's nearest length limit learns to
tell them from whole values, and then scores every record.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import forget, written
from .common import join_unique, uniform

#: Size of the hashed feature space.
BUCKETS = 1 << 16
#: Records that the classifier is fitted on; everything else reads all records.
FIT_RECORDS = 12_000
#: Sources whose limits go along with a function: at most a few hundred numbers each.
MAX_SOURCES = 10_000
#: Sampled values that must have a feature before it gets a weight.
LEAST_SEEN = 4
#: Endings by which interfaces mark a shortened text.
MARKERS = ("…", "...", " [more]", " […]", " [...]", " (more)", " read more")
#: Share of a source's values that lie within ``NEAR`` of its greatest length if that length is a limit.
HEAPED, NEAR = 0.02, 0.04
#: Values of one length, as a multiple of what its neighbours let expect, that make that length a limit.
SPIKE = 8

_DIGITS = re.compile(r"\d[\d,.]*\d|\d")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_|\n")
_PAIRS = (("[[", "]]"), ("{{", "}}"), ("{|", "|}"), ("<ref>", "</ref>"), ("<!--", "-->"), ("(", ")"), ("«", "»"), ("“", "”"))


def heaped_lengths(lengths: np.ndarray, counts: np.ndarray) -> list[int]:
    """Lengths, in ascending order, at which the values of a histogram with ascending ``lengths`` heap up.

    A heap has ``SPIKE`` times the values that its neighbours within ``NEAR`` let expect; of heaps that
    close together the greatest counts. The greatest length is one too if ``HEAPED`` of all values lie close below it.
    """
    if not len(lengths):
        return []
    total = np.r_[0, np.cumsum(counts)]
    wide = np.maximum(8, NEAR * lengths)
    around = total[np.searchsorted(lengths, lengths + wide, "right")] - total[np.searchsorted(lengths, lengths - wide)] - counts
    spikes = lengths[counts >= SPIKE * (around / (2 * wide) + 0.5)].tolist()
    top = int(lengths[-1])
    if counts[lengths >= (1 - NEAR) * top].sum() >= HEAPED * total[-1]:
        spikes.append(top)
    return sorted({int(x) for x in spikes if not any((1 - NEAR) * y <= x < y for y in spikes)})


def source_limits(docs: DataFrame, text_col: str, source_col: str) -> DataFrame:
    """(source, limits_chars, limits_bytes, records): the lengths at which each source's values heap up, in ascending order.

    Every source has a row; ``records`` counts its values that are neither null nor empty.
    """
    kind = dict(docs.dtypes)[source_col]
    size = lambda f: F.coalesce(f(text_col), F.lit(0)).alias("n")
    both = F.array(F.struct(F.lit("c").alias("unit"), size(F.length)), F.struct(F.lit("b").alias("unit"), size(F.octet_length)))
    sized = docs.select(F.col(source_col).alias("source"), F.inline(both))

    def run(key: tuple, h: pd.DataFrame) -> pd.DataFrame:  # a row per distinct length of the source
        h = h[h["n"] > 0].sort_values("n")
        chars, size = (h[h["unit"] == u] for u in "cb")
        found = [heaped_lengths(x["n"].to_numpy(), x["rows"].to_numpy()) for x in (chars, size)]
        return pd.DataFrame({"source": [key[0]], "limits_chars": found[:1], "limits_bytes": found[1:], "records": [int(chars["rows"].sum())]})

    histogram = sized.groupBy("source", "unit", "n").agg(F.count(F.lit(1)).alias("rows"))
    return histogram.groupBy("source").applyInPandas(run, f"source {kind}, limits_chars array<int>, limits_bytes array<int>, records bigint")


def length_limits(docs: DataFrame, text_col: str, source_col: str) -> DataFrame:
    """(source, limit_chars, limit_bytes): the greatest of each source's limits, null without any."""
    return source_limits(docs, text_col, source_col).select("source", F.array_max("limits_chars").alias("limit_chars"), F.array_max("limits_bytes").alias("limit_bytes"))


def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode()) & (BUCKETS - 1)


def line_kind(line: str) -> str:
    """The kind of markup that a line is."""
    if re.fullmatch(r"=+[^=]+=+\s*", line):
        return "heading"
    if line.startswith("="):
        return "open heading"
    if line[:1] in "*#:;":
        return "redirect" if line[:9].upper() == "#REDIRECT" else "list"
    if line.startswith(("{|", "|", "!")):
        return "table"
    if re.match(r"\[\[[^\[\]|:]+:", line):
        return "category"
    if line.startswith("{{"):
        return "template"
    return "prose" if line.strip() else "empty"


def gap_feature(length: int, limit: float | None) -> str:
    """How far a length is below the limit, in steps."""
    if limit is None or limit != limit or limit <= 0:
        return "none"
    gap = limit - length
    return next((name for most, name in ((0, "0"), (4, "4"), (16, "16"), (NEAR * limit, "near")) if gap <= most), "far")


def gap_to(length: int, limits: np.ndarray | None) -> str:
    """How far a length is below the nearest limit at or above it; far if the source's limits are all below it."""
    if limits is None or not len(limits):
        return "none"
    above = [x for x in limits if x >= length]
    return gap_feature(length, min(above)) if above else "far"


def features(text: str, gap_chars: str, gap_bytes: str) -> list[int]:
    """Hashed features of one value: its closing characters, punctuation, open markup and distances to the limit."""
    end = _DIGITS.sub("0", text[-160:])
    tail = end.rstrip()
    line = text.rstrip().rsplit("\n", 1)[-1]
    kind = line_kind(line)
    tokens = _TOKEN.findall(tail)[-4:]
    last = tokens[-1] if tokens else ""
    shape = "cap" if last[:1].isupper() else "low" if last[:1].isalpha() else last[:1]
    low = [t.lower() for t in tokens]
    f = [f"k={kind}", f"e={tail[-1:]}", f"ke={kind}{tail[-1:]}", f"sp={end[len(tail):][:1]}", f"ks={kind}{shape}", f"gc={gap_chars}", f"gb={gap_bytes}"]
    f += [f"s{n}={tail[-n:].lower()}" for n in (2, 3, 4, 6, 9, 14, 22)]
    f += [f"w{n}={' '.join(low[-n:])}" for n in (1, 2, 3)] + [f"kp={kind}{' '.join(low[-2:-1])}{shape}"]
    opened = [a for a, b in _PAIRS if (text.count(a) > text.count(b) if len(a) > 1 and a != "<ref>" else line.count(a) > line.count(b))]
    if line.rfind("<") > line.rfind(">"):
        opened.append("<")
    if line.count("'''") % 2:
        opened.append("'''")
    f += [f"o={o}" for o in opened] or ["o="]
    f += [f"ko={kind}{o}" for o in opened]
    f += [f"m={m}" for m in MARKERS if tail.endswith(m.strip())]
    f.append(f"n={min(len(text).bit_length(), 9)}")
    f.append(f"ne={min(len(text).bit_length(), 6)}{tail[-1:]}")
    return sorted({_hash(x) for x in f})


def cut_short(text: str, draw: np.random.Generator) -> str | None:
    """A part of the text that ends inside a word, sentence or markup; None if the text is too short for one."""
    if len(text) < 60 or len(set(text)) < 12:
        return None
    for _ in range(8):
        at = int(draw.integers(20, len(text) - 1))
        part, rest = text[:at], text[at:]
        bare = part.rstrip()
        if part.endswith("\n") or rest.lstrip(" ").startswith("\n") or not rest.strip() or not bare or bare[-1] in ".!?>":
            continue
        if draw.random() < 0.2:
            whole = bare.rsplit(" ", 1)[0]
            if len(whole) >= 20 and whole[-1] not in ".!?>":
                return whole + MARKERS[int(draw.integers(len(MARKERS)))]
        return part
    return None


class _Prepared:
    """The records with their sources' limits, which are found in one scan.

    Up to ``MAX_SOURCES`` sources' limits go along with the functions that read the records; those of more sources are
    joined to them, where a source with very many records takes the other way of ``join_unique``.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, source_col: str):
        limits = written(source_limits(docs, text_col, source_col))
        self.rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
        self.total = limits.agg(F.sum("records")).first()[0] or 0
        few = limits.limit(MAX_SOURCES + 1).collect()
        self.known = {r["source"]: (r["limits_chars"], r["limits_bytes"]) for r in few} if len(few) <= MAX_SOURCES else None
        if self.known is not None:
            forget(limits)
        else:
            key = F.to_json(F.struct("source"))  # null is a source too
            named = limits.select(key.alias("_k"), "limits_chars", "limits_bytes", F.col("records").alias("_n"))
            self.rows = join_unique(self.rows.withColumn("_k", key), named.drop("_n"), ["_k"], named).drop("_k")

    def reader(self):
        """A function from a batch to its (id, text, source, limits of characters, limits of bytes)."""
        known = self.known

        def read(b: pd.DataFrame) -> Iterator[tuple]:
            if known is None:
                return zip(b["id"], b["text"], b["source"], b["limits_chars"], b["limits_bytes"])
            source = b["source"].astype(object).where(b["source"].notna(), None)
            return ((i, text, s, *known[s]) for i, text, s in zip(b["id"], b["text"], source))

        return read


def fit(prepared: _Prepared, records: int = FIT_RECORDS, seed: int = 0) -> np.ndarray:
    """Weights fitted on the about ``records`` different records of the smallest hash, as they are and cut short.

    At most 2 * ``records`` examples come to the driver; which ones does not depend on the order of tasks. Values close to a
    length limit are no examples of whole ones. Others that were already cut still count as whole at first: each half of the
    sample is judged by a fit on the other half, and what that finds cut is left out of the final fit.
    """
    share = min(1.0, records / max(prepared.total, 1) * (1 + 6 / records**0.5))
    u = uniform(F.lit(seed), F.col("id"), F.col("text"))
    drawn = prepared.rows.where("trim(text) <> ''").where(u < share).withColumn("u", u)
    read = prepared.reader()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for u, (_, text, _, chars, size) in zip(b["u"], read(b)):
                fold = int(u * (1 << 52)) % 2  # by record, whatever the type that a batch gives its id
                draw = np.random.default_rng([seed, zlib.crc32(text.encode())])
                gaps = (gap_to(len(text), chars), gap_to(len(text.encode()), size))
                if set(gaps) <= {"far", "none"}:
                    out.append((u, 0, fold, features(text, *_supposed(gaps, draw, 0.15))))
                if (part := cut_short(text, draw)) is not None:
                    away = tuple("none" if g == "none" else "far" for g in gaps)
                    out.append((u, 1, fold, features(part, *_supposed(away, draw, 0.5))))
            yield pd.DataFrame(out, columns=["u", "cut", "fold", "at"])

    once = drawn.mapInPandas(run, "u double, cut int, fold int, at array<int>").groupBy("u", "cut").agg(F.min(F.struct("fold", "at")).alias("x"))
    sample = once.orderBy("u", "cut").limit(2 * records).select("cut", "x.fold", "x.at").toPandas()
    if not len(sample) or sample["cut"].nunique() < 2:
        return np.zeros(BUCKETS)
    key = np.array([zlib.crc32(np.asarray(a).tobytes()) for a in sample["at"]])
    sample = sample.iloc[np.lexsort((key, sample["fold"], sample["cut"]))]  # whatever the order of tasks
    half = sample["fold"].to_numpy() == 0
    y = sample["cut"].to_numpy(dtype=float)
    sizes = sample["at"].map(len).to_numpy()
    flat = np.concatenate(sample["at"].to_numpy())
    flat = np.where(np.bincount(flat, minlength=BUCKETS)[flat] >= LEAST_SEEN, flat, BUCKETS)  # rarer features share a bucket of weight 0
    keep = np.ones(len(y), dtype=bool)
    for own in (half, ~half):
        if len(np.unique(y[~own])) == 2:
            w = logistic(flat[np.repeat(~own, sizes)], sizes[~own], y[~own])
            keep &= ~own | (y > 0) | (_margin(w, flat, sizes) < 0)
    return logistic(flat[np.repeat(keep, sizes)], sizes[keep], y[keep])[:BUCKETS]


def _supposed(gaps: tuple, draw: np.random.Generator, share: float) -> tuple:
    """The gaps, or with probability ``share`` gaps as at the limit of a source that has one."""
    if draw.random() >= share:
        return gaps
    near = ("0", "4", "16", "near")
    chars, size = near[int(draw.integers(4))], near[int(draw.integers(4))]
    return ((chars, "none"), ("none", size), (chars, size))[int(draw.integers(3))]


def _margin(w: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.add.reduceat(w[flat], np.r_[0, np.cumsum(sizes)[:-1]])


def logistic(flat: np.ndarray, sizes: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 150, rate: float = 0.1) -> np.ndarray:
    """Logistic regression on rows of binary features, by full-batch gradient steps of adaptive size.

    The last weight belongs to the features that are too rare and stays 0.
    """
    w, m, v = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    row = np.repeat(np.arange(len(sizes)), sizes)
    for t in range(1, rounds + 1):
        err = 1 / (1 + np.exp(-_margin(w, flat, sizes).clip(-30, 30))) - y
        g = np.bincount(flat, err[row], BUCKETS + 1) / len(y) + penalty * w
        g[BUCKETS] = 0
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def truncation_scores(docs: DataFrame, id_col: str, text_col: str, source_col: str, records: int = FIT_RECORDS, seed: int = 0) -> DataFrame:
    """(id, source, score, truncated) of every record; ``score`` is the believed probability that the value was cut.

    Three scans: one for the sources' limits, one for the sample, one to score. Null and blank values were not cut: score 0. Where nothing can be learned, as in an empty table or
    one of short values only, every score is 0.5 and no value counts as cut. Repeated rows are scored as often as they occur.
    """
    prepared = _Prepared(docs, id_col, text_col, source_col)
    weights = fit(prepared, records, seed).astype(np.float32)
    kind, read = dict(docs.dtypes), prepared.reader()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for _, text, _, chars, size in read(b):
                if text is None or not text.strip():
                    out.append(0.0)
                else:
                    at = features(text, gap_to(len(text), chars), gap_to(len(text.encode()), size))
                    out.append(float(1 / (1 + np.exp(-np.clip(weights[at].sum(), -30, 30)))))
            yield pd.DataFrame({"id": b["id"], "source": b["source"], "score": out})

    scored = prepared.rows.mapInPandas(run, f"id {kind[id_col]}, source {kind[source_col]}, score double")
    return scored.withColumn("truncated", F.col("score") > 0.5)


def truncation_rates(scores: DataFrame) -> DataFrame:
    """(source, records, truncated, rate) per source."""
    cut = F.col("truncated").cast("bigint")
    return scores.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum(cut).alias("truncated"), F.avg(cut.cast("double")).alias("rate"))
