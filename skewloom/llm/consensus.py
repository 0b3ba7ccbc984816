"""Consensus from several annotators' labels, by message passing between items and annotators.

Every label is an edge between an item and an annotator. For each class, taken against the rest, an
annotator has two rates: how often they name the class where it is right, and where it is not. The
annotator's message along an edge is the log-likelihood ratio of what they said; the item's message
back is its belief in each class without that annotator's own message. Rounds alternate until the
rates are stable.

Annotators and classes are coded as numbers and whole blocks of items with their edges are one row, so a round is one
pass over flat arrays and an aggregate of partial sums, and shuffles only the rates. Where the rates are too many for
every task, edges are rows, and rates and item scores are tables joined to them.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import bound
from ..storage import forget, written
from .common import join_unique, plain

#: Rates that may be held by every task and the driver: annotators times classes, a few arrays of 1.6 MB.
MAX_RATES = 200_000
#: Weight, in labels, of an annotator's overall accuracy in each of their rates.
PRIOR_LABELS = 4.0


def latest_votes(annotations: DataFrame, item: str, annotator: str, fields: dict[str, str], order: list[str]) -> DataFrame:
    """(item, annotator, attr, value): each annotator's last annotation of an item, one row per field.

    The last is the greatest by ``order`` and then by content. It replaces the earlier ones as a
    whole, so a field left empty withdraws its vote. Rows without item or annotator drop out.
    """
    last = F.max(F.struct(*order, *fields)).alias("_r")
    kept = annotations.where(F.col(item).isNotNull() & F.col(annotator).isNotNull()).groupBy(item, annotator).agg(last)
    pairs = F.array(*(F.struct(F.lit(attr).alias("attr"), F.col(f"_r.{f}").alias("value")) for f, attr in fields.items()))
    return kept.select(F.col(item).alias("item"), F.col(annotator).alias("annotator"), F.inline(pairs))


def match_options(votes: DataFrame, options: DataFrame) -> DataFrame:
    """(item, annotator, attr, option): votes that name an option under plain compare; others do not count."""
    by_text = options.select("attr", plain("option_value").alias("_p"), F.col("option_id").alias("option")).dropna()
    by_text = by_text.groupBy("attr", "_p").agg(F.min("option").alias("option"))
    return votes.withColumn("_p", plain("value")).join(by_text, ["attr", "_p"]).select("item", "annotator", "attr", "option")


def pack(votes: DataFrame) -> DataFrame:
    """(attr, item, who, what, vote): one row per item with a vote, holding the annotators and options of its edges."""
    edges = F.sort_array(F.collect_list(F.struct("annotator", "option", "vote")))
    packed = votes.groupBy("attr", "item").agg(edges.alias("_e")).where(F.exists("_e", lambda e: e["vote"]))
    return packed.select("attr", "item", F.col("_e.annotator").alias("who"), F.col("_e.option").alias("what"), F.col("_e.vote").alias("vote"))


def beliefs(option_at: np.ndarray, begin: np.ndarray, size: np.ndarray, says: np.ndarray, silent: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Item beliefs [items, classes] and item-to-annotator messages [edges, classes].

    ``begin`` and ``size`` say which edges are an item's. ``says`` holds for each edge the log-likelihood ratio of the class
    that it names, ``silent`` those of the classes if they are not named.
    """
    message = silent.copy()
    message[np.arange(len(option_at)), option_at] = says
    score = np.add.reduceat(message, begin, axis=0) + (np.log(prior) - np.log1p(-prior))
    return _share(score), _share(np.repeat(score, size, axis=0) - message)


def _share(score: np.ndarray) -> np.ndarray:
    p = np.exp(score - score.max(axis=1, keepdims=True)) if len(score) else score
    return p / p.sum(axis=1, keepdims=True) if len(score) else p


class Rates:
    """The annotators' rates for one attribute and their log-likelihood ratios."""

    def __init__(self, named: np.ndarray, right: np.ndarray, belief: np.ndarray, prior: np.ndarray):
        """``named``, ``right`` and ``belief`` [annotators, classes]: labels given, their believed part, belief mass seen."""
        total = np.maximum(named.sum(axis=1, keepdims=True), 1e-9)
        self.accuracy = (right.sum(axis=1) + 1.0) / (total[:, 0] + 2.0)
        acc = self.accuracy[:, None]
        hit = (right + PRIOR_LABELS * acc) / (belief + PRIOR_LABELS)
        false = (named - right + PRIOR_LABELS * (1 - acc) * named.clip(0.5) / total.clip(1)) / (np.maximum(total - belief, 0) + PRIOR_LABELS)
        hit, false = np.clip(hit, 1e-3, 1 - 1e-3), np.clip(false, 1e-4, 1 - 1e-3)
        self.says, self.silent = np.log(hit / false), np.log((1 - hit) / (1 - false))
        self.prior = np.clip(prior / max(prior.sum(), 1e-9), 1e-6, 1 - 1e-6)
        self.hit, self.false = hit, false


def consensus(votes: DataFrame, extra: DataFrame | None = None, max_rounds: int = 30, tolerance: float = 2e-3) -> tuple[DataFrame, DataFrame]:
    """Consensus per item and reliability per annotator, from (item, annotator, attr, option) edges.

    ``extra`` edges, such as a record's own label, take part in the messages as annotators of their
    own but are no votes: they count neither as disagreement nor in the agreement.

    The first result has (attr, item, option, confidence, agreement, annotators, options): the option
    of the greatest belief (ties: the smallest id), its belief, the share of the votes that name it,
    and the numbers of votes and of different options. The second has (attr, annotator, labels,
    reliability): the believed share of the annotator's labels that are right, with one right and
    one wrong label added. Items without a vote do not occur. Repeated edges of one annotator on an item
    count once (the smallest option). Empty votes give two empty results. Rounds end when no hit or false
    rate moves by ``tolerance``; if one still does after ``max_rounds``, a RuntimeWarning says so.
    """
    votes = votes.withColumn("vote", F.lit(True))
    if extra is not None:
        votes = votes.unionByName(extra.withColumn("vote", F.lit(False)))
    votes = votes.groupBy("item", "annotator", "attr").agg(F.min("option").alias("option"), F.max("vote").alias("vote"))
    packed = written(pack(votes))
    edges = packed.select("attr", F.explode(F.arrays_zip("who", "what")).alias("v")).select("attr", F.col("v.who").alias("annotator"), F.col("v.what").alias("option"))
    counts = written(edges.groupBy("attr", "annotator", "option").count())
    few = counts.limit(MAX_RATES + 1).toPandas()
    classes = _grouped((few if len(few) <= MAX_RATES else counts.select("attr", "option").distinct().toPandas())[["attr", "option"]])
    if len(few) > MAX_RATES or few["annotator"].nunique() * sum(map(len, classes.values())) > MAX_RATES:
        return _consensus_by_join(packed, counts, classes, max_rounds, tolerance)
    forget(counts)
    at = pd.Index(sorted(few["annotator"].unique()))
    named = {attr: np.zeros((len(at), len(own))) for attr, own in classes.items()}
    for attr, part in few.groupby("attr"):
        named[attr][at.get_indexer(part["annotator"]), np.searchsorted(classes[attr], part["option"].to_numpy())] = part["count"]
    kinds = {c: packed.schema[c].dataType for c in ("item", "who", "what")}
    item_kind = kinds["item"].simpleString()
    blocks = written(packed.mapInPandas(_coded(classes, at), f"attr string, item array<{item_kind}>, size array<int>, who array<int>, what array<int>, vote array<boolean>"))
    forget(packed)
    state = dict.fromkeys(classes)

    for _ in range(max_rounds):
        sums = blocks.mapInPandas(_partial_sums(state, classes, at), "attr string, at int, right array<double>, belief array<double>, prior array<double>")
        new, moved = {}, 0.0
        totals = _summed(sums)
        for attr, own in classes.items():
            right, belief, prior = (np.zeros((len(at), len(own))), np.zeros((len(at), len(own))), np.zeros(len(own)))
            for i, (r, b, p) in totals.get(attr, {}).items():
                if i < 0:
                    prior = p
                else:
                    right[i], belief[i] = r, b
            new[attr] = Rates(named[attr], right, belief, prior)
            seen = named[attr].sum(axis=1) > 0
            both = ((new[attr].hit, state[attr].hit), (new[attr].false, state[attr].false)) if state[attr] is not None else ()
            moved = max(moved, *(np.abs(a - b)[seen].max() for a, b in both)) if both else 1.0
        state = new
        if moved < tolerance:
            break
    else:
        _not_converged(max_rounds, moved)

    option_kind, name_kind = (kinds[c].elementType.simpleString() for c in ("what", "who"))
    items = blocks.mapInPandas(_decide(state, classes), f"attr string, item {item_kind}, option {option_kind}, confidence double, agreement double, annotators int, options int")
    judged = blocks.mapInPandas(_judge(state, classes, at), f"attr string, annotator {name_kind}, labels bigint, right double")
    total = judged.groupBy("attr", "annotator").agg(F.sum("labels").alias("labels"), F.sum("right").alias("right"))
    return items, total.select("attr", "annotator", "labels", ((F.col("right") + 1) / (F.col("labels") + 2)).alias("reliability"))


def _consensus_by_join(packed: DataFrame, counts: DataFrame, classes: dict, max_rounds: int, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """The same rounds for any number of annotators and of edges an item: a row per edge, to which the annotators' rates and
    the items' scores are joined as tables, written each round. Sums are combined before they are shuffled, and annotators
    or items with very many edges take the other way of ``join_unique``."""
    kind = packed.schema["what"].dataType.elementType.simpleString()
    rows = [(a, o, k, len(own)) for a, own in classes.items() for k, o in enumerate(own)]
    place = F.broadcast(packed.sparkSession.createDataFrame(rows, f"attr string, option {kind}, pos int, n int"))  # a row per class
    every = packed.select("attr", "item", F.explode(F.arrays_zip("who", "what", "vote")).alias("e"))
    every = every.select("attr", "item", F.col("e.who").alias("annotator"), F.col("e.what").alias("option"), "e.vote")
    edges = written(every.join(place, ["attr", "option"]).drop("option"))
    named = counts.join(place, ["attr", "option"]).select("attr", "annotator", "pos", F.col("count").alias("named"))
    many = written(counts.groupBy("attr", "annotator").agg(F.sum("count").alias("_n")))
    rates, prior, scores, before = None, {}, None, (None, None)
    for _ in range(max_rounds):
        sent = _sent(edges, rates, many)
        scores = written(_scores(sent, rates is not None, prior))
        fed = _fed(sent, scores, rates is not None)
        at = lambda c, k: F.transform(c, lambda x, i: F.when(i == k, x).otherwise(0.0))
        total = fed.groupBy("attr", "annotator").agg(_total(at(F.col("message"), F.col("pos"))).alias("right"), _total(F.col("message")).alias("belief"))
        cell = total.select("attr", "annotator", F.posexplode(F.arrays_zip("right", "belief")).alias("pos", "x"))
        new = written(_rate_table(cell.select("attr", "annotator", "pos", "x.right", "x.belief"), named))
        mass = scores.groupBy("attr").agg(_total(F.col("belief")).alias("p")).collect()  # a number per class
        prior = {r["attr"]: np.clip(np.array(r["p"]) / max(sum(r["p"]), 1e-9), 1e-6, 1 - 1e-6).tolist() for r in mass}
        moved = 1.0 if rates is None else _moved(new, rates)
        for old in before:
            forget(old)
        before, rates = (rates, scores), new
        if moved < tolerance:
            break
    else:
        _not_converged(max_rounds, moved)
    sent = _sent(edges, rates, many)
    scores = written(_scores(sent, True, prior))
    fed = _fed(sent, scores, True)
    options = F.broadcast(packed.sparkSession.createDataFrame([(a, list(own)) for a, own in classes.items()], f"attr string, _o array<{kind}>"))  # a row per attribute
    confidence = F.array_max("belief")
    best = F.array_position("belief", confidence).cast("int") - 1
    votes = F.aggregate("votes", F.lit(0.0), lambda s, x: s + x)
    items = scores.where("array_max(votes) > 0").join(options, "attr").select(
        "attr", "item", F.get("_o", best).alias("option"), confidence.alias("confidence"), (F.get("votes", best) / votes).alias("agreement"),
        votes.cast("int").alias("annotators"), F.size(F.filter("votes", lambda x: x > 0)).alias("options"),
    )
    total = fed.groupBy("attr", "annotator").agg(F.count(F.lit(1)).alias("labels"), F.sum(F.get("belief", F.col("pos"))).alias("right"))
    return items, total.select("attr", "annotator", "labels", ((F.col("right") + 1) / (F.col("labels") + 2)).alias("reliability"))


def _total(array: Column) -> Column:
    """The sum of arrays by position, combined before the shuffle."""
    return vector_to_array(Summarizer.sum(array_to_vector(array)))


def _softmax(score: Column) -> Column:
    """Shares in proportion to the exponentials."""
    powers = bound(F.array_max(score), lambda m: F.transform(score, lambda x: F.exp(x - m)))
    return _part(powers)


def _part(array: Column) -> Column:
    return bound(array, lambda v: bound(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), lambda t: F.transform(v, lambda x: x / t)))


def _sent(edges: DataFrame, rates: DataFrame | None, many: DataFrame) -> DataFrame:
    """Edges with the annotator's message ``said``: log-likelihood ratios, or in the first round the vote itself."""
    if rates is None:
        return edges.withColumn("said", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.when(i == F.col("pos"), 1.0).otherwise(0.0)))
    rated = join_unique(edges, rates.select("attr", "annotator", "says", "silent"), ["attr", "annotator"], many)
    said = F.transform("silent", lambda x, i: F.when(i == F.col("pos"), F.get("says", F.col("pos"))).otherwise(x))
    return rated.withColumn("said", said).drop("says", "silent")


def _scores(sent: DataFrame, rated: bool, prior: dict) -> DataFrame:
    """(attr, item, score, belief, votes, _n): each item's sum of messages, its beliefs, the votes per class and its edges."""
    own = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.when((i == F.col("pos")) & F.col("vote"), 1.0).otherwise(0.0))
    sums = sent.groupBy("attr", "item").agg(_total(F.col("said")).alias("score"), _total(own).alias("votes"), F.count(F.lit(1)).alias("_n"))
    if not rated:
        return sums.withColumn("belief", _part(F.col("score")))
    odds = [(a, [float(x) for x in np.log(p) - np.log1p(-np.array(p))]) for a, p in prior.items()]
    known = F.broadcast(sent.sparkSession.createDataFrame(odds, "attr string, _p array<double>"))  # a row per attribute
    sums = sums.join(known, "attr").withColumn("score", F.zip_with("score", "_p", lambda x, y: x + y)).drop("_p")
    return sums.withColumn("belief", _softmax(F.col("score")))


def _fed(sent: DataFrame, scores: DataFrame, rated: bool) -> DataFrame:
    """Edges with the item's ``belief`` and its ``message``, the belief without what this annotator sent."""
    both = join_unique(sent, scores.select("attr", "item", "score", "belief"), ["attr", "item"], scores)
    rest = F.zip_with("score", "said", lambda x, y: x - y)
    if rated:
        return both.withColumn("message", _softmax(rest))
    alone = F.array_max(rest) <= 0  # the only vote counts, as there is no other
    return both.withColumn("message", F.when(alone, F.col("belief")).otherwise(_part(rest)))


def _moved(new: DataFrame, old: DataFrame) -> float:
    """The greatest movement of a hit or false rate."""
    pairs = new.join(old.select("attr", "annotator", F.col("hit").alias("_h"), F.col("false").alias("_f")), ["attr", "annotator"])
    most = lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    return pairs.agg(F.max(F.greatest(most("hit", "_h"), most("false", "_f")))).first()[0] or 0.0


def _not_converged(rounds: int, moved: float) -> None:
    warnings.warn(f"consensus: a rate still moves by {moved:.4f} after max_rounds = {rounds}", RuntimeWarning, stacklevel=3)


def _rate_table(total: DataFrame, named: DataFrame) -> DataFrame:
    """(attr, annotator, accuracy, says, silent, hit, false) by the formulas of ``Rates``."""
    own = Window.partitionBy("attr", "annotator")
    d = total.join(named, ["attr", "annotator", "pos"], "left").fillna(0, ["named"])
    d = d.withColumn("labels", F.sum("named").over(own)).withColumn("acc", (F.sum("right").over(own) + 1) / (F.col("labels") + 2))
    hit = (F.col("right") + PRIOR_LABELS * F.col("acc")) / (F.col("belief") + PRIOR_LABELS)
    some = F.greatest("named", F.lit(0.5)) / F.greatest("labels", F.lit(1))
    false = (F.col("named") - F.col("right") + PRIOR_LABELS * (1 - F.col("acc")) * some) / (F.greatest(F.col("labels") - F.col("belief"), F.lit(0.0)) + PRIOR_LABELS)
    clip = lambda c, a: F.least(F.greatest(c, F.lit(a)), F.lit(1 - 1e-3))
    d = d.withColumn("h", clip(hit, 1e-3)).withColumn("f", clip(false, 1e-4))
    each = F.sort_array(F.collect_list(F.struct("pos", F.log(F.col("h") / F.col("f")).alias("says"), F.log((1 - F.col("h")) / (1 - F.col("f"))).alias("silent"), "h", "f")))
    out = d.groupBy("attr", "annotator").agg(F.first("acc").alias("accuracy"), each.alias("v"))
    return out.select("attr", "annotator", "accuracy", F.col("v.says").alias("says"), F.col("v.silent").alias("silent"), F.col("v.h").alias("hit"), F.col("v.f").alias("false"))


def _grouped(pairs: pd.DataFrame) -> dict:
    """{attr: its options in ascending order}."""
    return {attr: sorted(own.unique().tolist()) for attr, own in pairs.groupby("attr")["option"]}


def _summed(sums: DataFrame) -> dict:
    """{attr: {annotator: (right, belief, prior)}}: partial vectors, of which every task gives one per annotator, added up by position."""
    cell = sums.select("attr", "at", F.posexplode(F.arrays_zip("right", "belief", "prior")).alias("pos", "x"))
    total = cell.groupBy("attr", "at", "pos").agg(F.sum("x.right").alias("r"), F.sum("x.belief").alias("b"), F.sum("x.prior").alias("p"))
    ordered = total.groupBy("attr", "at").agg(F.sort_array(F.collect_list(F.struct("pos", "r", "b", "p"))).alias("v"))
    out: dict = {}
    for r in ordered.collect():
        v = np.array([(x["r"], x["b"], x["p"]) for x in r["v"]])
        out.setdefault(r["attr"], {})[r["at"]] = (v[:, 0], v[:, 1], v[:, 2])
    return out


def _coded(classes: dict, at: pd.Index):
    """Blocks of items: flat arrays of their edges' annotators, classes and votes, and each item's number of edges."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for attr, part in b.groupby("attr", sort=False):
                who, what, vote = (np.concatenate(part[c].to_numpy()) for c in ("who", "what", "vote"))
                codes = at.get_indexer(who).astype(np.int32), np.searchsorted(classes[attr], what).astype(np.int32)
                size = part["who"].map(len).to_numpy(dtype=np.int32)
                yield pd.DataFrame({"attr": [attr], "item": [part["item"].to_numpy()], "size": [size], "who": [codes[0]], "what": [codes[1]], "vote": [vote]})

    return run


def _believed(batches: Iterator[pd.DataFrame], classes: dict, state: dict) -> Iterator[tuple]:
    """(block, its attribute's options, edges' annotators and classes, beliefs, messages) of every block."""
    for b in batches:
        for r in b.itertuples(index=False):
            own, rates, size, who, what = classes[r.attr], state[r.attr], np.asarray(r.size), np.asarray(r.who), np.asarray(r.what)
            if rates is None:
                yield r, own, who, what, *_vote_shares(np.repeat(np.arange(len(size)), size), what, len(size), len(own))
            else:
                begin = np.r_[0, np.cumsum(size)[:-1]]
                yield r, own, who, what, *beliefs(what, begin, size, rates.says[who, what], rates.silent[who], rates.prior)


def _vote_shares(item_at: np.ndarray, what: np.ndarray, items: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The first round: shares of the votes, and for the messages without the annotator's own vote where there are others."""
    tally = np.bincount(item_at * classes + what, minlength=items * classes).reshape(items, classes).astype(float)
    rest = tally[item_at]
    rest[np.arange(len(what)), what] -= 1.0
    alone = rest.sum(axis=1) == 0
    rest[alone] = tally[item_at][alone]
    return tally / tally.sum(axis=1, keepdims=True), rest / rest.sum(axis=1, keepdims=True)


def _partial_sums(state: dict, classes: dict, at: pd.Index):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for r, own, who, what, belief, message in _believed(batches, classes, state):
            shape = len(at), len(own)
            right, seen, prior = total.setdefault(r.attr, (np.zeros(shape), np.zeros(shape), np.zeros(shape[1])))
            right += np.bincount(who * shape[1] + what, message[np.arange(len(what)), what], shape[0] * shape[1]).reshape(shape)
            for k in range(shape[1]):
                seen[:, k] += np.bincount(who, message[:, k], shape[0])
            prior += belief.sum(axis=0)
        for attr, (right, seen, prior) in total.items():
            some = np.flatnonzero(seen.sum(axis=1))
            none = [0.0] * len(prior)
            yield pd.DataFrame({"attr": attr, "at": [-1, *some], "right": [none, *right[some].tolist()], "belief": [none, *seen[some].tolist()], "prior": [prior.tolist(), *[none] * len(some)]})

    return run


def _judge(state: dict, classes: dict, at: pd.Index):
    """Labels and believed right labels of each annotator, one row per task; beliefs count all messages here."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for r, _, who, what, belief, _ in _believed(batches, classes, state):
            labels, right = total.setdefault(r.attr, (np.zeros(len(at)), np.zeros(len(at))))
            labels += np.bincount(who, minlength=len(at))
            right += np.bincount(who, belief[np.repeat(np.arange(len(belief)), r.size), what], len(at))
        for attr, (labels, right) in total.items():
            some = np.flatnonzero(labels)
            yield pd.DataFrame({"attr": attr, "annotator": at[some].to_numpy(), "labels": labels[some].astype(np.int64), "right": right[some]})

    return run


def _decide(state: dict, classes: dict):
    """The result rows of every block's items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r, own, _, what, belief, _ in _believed(batches, classes, state):
            best, row = belief.argmax(axis=1), np.arange(len(belief))
            cell = np.repeat(row, r.size) * len(own) + what
            tally = np.bincount(cell, np.asarray(r.vote, dtype=float), belief.size).reshape(belief.shape)
            yield pd.DataFrame({
                "attr": r.attr, "item": r.item, "option": np.array(own)[best], "confidence": belief[row, best],
                "agreement": tally[row, best] / tally.sum(axis=1), "annotators": tally.sum(axis=1).astype(np.int32), "options": (tally > 0).sum(axis=1).astype(np.int32),
            })

    return run
