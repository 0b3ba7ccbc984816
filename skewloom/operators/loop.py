"""Rounds of vote, selection and variation, with resume.

A round's state is its survivors, a Parquet partition, and one line in the log, written in that
order: the log counts finished rounds, and a repeated round replaces its partition. All noise is
keyed by (seed, round, id), so a resumed loop goes on as an uninterrupted one would.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashrng import normal
from ..functions.labels import clean_value, has_text, inherited_labels, labels_from_map
from ..sources.caches import through_cache
from ..sources.connectors import ask, label_prompt, parse_labels
from ..sources.runlog import prior_as_round
from ..sources.sinks import append_log, write_round
from ..spec import Dataset, Vocabulary, scheduled_strength
from ..storage import forget, temporary_tables, written
from .agreement import jensen_shannon
from .knn import vote_histogram
from .raking import marginals, raked_select
from .report import metric_means
from .selection import assign_cells, keep_cells, quota_select, selection_info, top_k
from .splits import drawn


@dataclass(frozen=True)
class Settings:
    """Settings of a loop. ``mode``: 'plain' (top-K), 'joint' (quotas of joint cells) or 'raked'.

    ``max_cells``: joint cells that are kept, the rarest count as one. ``by``: a class within which candidates are voted for
    and selected, ``class_k`` of each (class -> K, in place of ``k``). ``prior``: rows of a first sample whose metrics are
    round -1.
    """

    k: int
    variations: int
    last: int
    sigma: float
    strength: float = 0.0
    schedule: str = "constant"
    mode: str = "plain"
    blind: Sequence[str] = ()
    klass: Sequence[str] = ()
    attributes: Sequence[str] = ()
    seed: int = 0
    by: str | None = None
    class_k: Mapping | None = None
    max_cells: int | None = None
    prior: int = 0

    @property
    def survivors(self) -> int:
        return sum(self.class_k.values()) if self.class_k else self.k

    @classmethod
    def of_budget(cls, dataset: Dataset, epsilon: float, k: int, variations: int, **how) -> Settings:
        """Rounds, noise and column roles of a dataset at a privacy budget."""
        last, sigma = dataset.budget(epsilon)
        roles = {"blind": dataset.blind_attributes, "klass": dataset.class_attributes, "attributes": dataset.attributes, "by": dataset.class_id}
        return cls(**{"k": k, "variations": variations, "last": last, "sigma": sigma, **roles, **how})


Transform = Callable[[DataFrame], DataFrame]


def noisy(votes: DataFrame, sigma: float, seed: int, t: int) -> DataFrame:
    """Adds ``score``: votes with Gaussian noise of a deviation ``sigma``."""
    noise = normal(seed, f"vote{t}", F.col("cand_id")) * F.lit(float(sigma)) if sigma else F.lit(0.0)
    return votes.withColumn("score", F.round(F.col("votes") + noise, 9))


def labelled(df: DataFrame, label: Transform, attributes: Sequence[str], prefix: str) -> DataFrame:
    """``df`` with an annotator's labels as ``<prefix><attribute>``; the attributes that it carries stay as they are."""
    have = [a for a in attributes if a in df.columns]
    got = label(df.withColumns({f"_meta_{a}": F.col(a) for a in have}))
    got = got.withColumns({prefix + a: F.col(a) for a in attributes if a in got.columns})
    return got.drop(*attributes).withColumnsRenamed({f"_meta_{a}": a for a in have})


def one_round(
    candidates: DataFrame, voters: DataFrame, target: DataFrame, s: Settings, t: int, embed: Transform, label: Transform, judge: Transform | None = None
) -> DataFrame:
    """The survivors of round t: blank texts out, embed, vote, noise, label, select, judge.

    Adds votes, score, in_base, by_quota, the labels that the selection used (loop_<attribute>) and those of ``judge``, or the
    same annotator without one, on the survivors (eval_<attribute>). What several steps read is written once; the selection
    moves no texts or vectors.
    """
    ready = written(labelled(embed(candidates.where(has_text(F.col("text")))), label, s.attributes, "loop_"))
    votes = noisy(vote_histogram(voters, ready.withColumnRenamed("cand_id", "id"), s.by), s.sigma, s.seed, t)
    needed = dict.fromkeys(["cand_id", *([s.by] if s.by else []), *(f"loop_{a}" for a in s.blind)])
    chosen = _selected(written(votes.join(ready.select(*needed), "cand_id")), target, s, t)
    chosen = chosen.drop(*(c for c in needed if c != "cand_id")).join(ready, "cand_id")
    if judge is None:
        return chosen.withColumns({f"eval_{a}": F.col(f"loop_{a}") for a in s.attributes if f"loop_{a}" in chosen.columns})
    return labelled(chosen, judge, s.attributes, "eval_")


def _selected(scored: DataFrame, target: DataFrame, s: Settings, t: int) -> DataFrame:
    strength = scheduled_strength(t, s.last, s.strength, s.schedule)
    run = [s.by] if s.by and s.class_k else []
    kind = dict(scored.dtypes)[s.by] if run else None
    k = scored.sparkSession.createDataFrame(list(s.class_k.items()), f"{s.by} {kind}, k bigint") if run else s.k
    if s.mode == "plain":
        return top_k(scored, k, run).drop("rank").withColumn("in_base", F.lit(True)).withColumn("by_quota", F.lit(True))
    loop = [f"loop_{a}" for a in s.blind]
    named = target.withColumnsRenamed({a: f"loop_{a}" for a in s.blind})
    if s.mode == "raked":
        own = marginals(named, loop, run) if run and s.by in target.columns else None
        return raked_select(scored, marginals(named, loop), loop, strength, k, run, own)
    cell = F.concat_ws("\x1f", *loop)
    goal = target_cells(named.select(cell.alias("cell")), s.max_cells)
    cells = scored.withColumn("cell", cell)
    if s.max_cells:
        cells = assign_cells(cells, goal, "cell")
    return quota_select(cells, goal, strength, k, run)


def target_cells(cells: DataFrame, most: int | None) -> DataFrame:
    """(cell, p): shares of the joint cells, of the ``most`` kept ones if given."""
    if most:
        return keep_cells(cells, "cell", most)
    goal = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    return goal.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy())).drop("n")  # a row per cell


def round_metrics(chosen: DataFrame, target: DataFrame, s: Settings, t: int, reference: DataFrame | None = None, diverge: Callable[[DataFrame], float] | None = None, **more) -> DataFrame:
    """One row: jsd_<attribute> of the judged labels to the reference (the target if none), their means, distances to the target of the
    loop's and the judged blind labels, chosen, shortfall, moved, strength, and the divergence of the survivors if it is measured."""
    spark = chosen.sparkSession
    each = lambda d, names, prefix="": d.select(F.inline(F.array(*(F.struct(F.lit(a).alias("attr"), F.col(prefix + a).alias("value")) for a in names))))
    jsd = jensen_shannon(each(chosen, s.attributes, "eval_"), each(target if reference is None else reference, s.attributes), ["attr"])
    own = jsd.agg(*(F.max(F.when(F.col("attr") == a, F.col("jsd"))).alias(f"jsd_{a}") for a in s.attributes))
    out = metric_means(jsd, s.blind, s.klass).crossJoin(own)  # one row each, here and below
    for source in ("loop", "eval") if s.blind else ():
        to_goal = jensen_shannon(each(chosen, s.blind, f"{source}_"), each(target, s.blind), ["attr"]).agg(F.avg("jsd").alias(f"marg_jsd_vs_phat_{source}_labels"))
        out = out.crossJoin(to_goal)
    if "in_base" in chosen.columns:
        out = out.crossJoin(selection_info(chosen, s.survivors))
    fixed = {"round": t, "lam_t": float(scheduled_strength(max(t, 0), s.last, s.strength, s.schedule)), **more}
    if diverge is not None:
        fixed["divergence"] = float(diverge(chosen))
    return out.crossJoin(spark.createDataFrame([tuple(fixed.values())], list(fixed)))


def run_loop(
    start: DataFrame, voters: DataFrame, target: DataFrame, s: Settings, path: str, embed: Transform, label: Transform, vary: Callable[[DataFrame, int], DataFrame],
    judge: Transform | None = None, reference: DataFrame | None = None, diverge: Callable[[DataFrame], float] | None = None,
) -> DataFrame:
    """All rounds 0 to ``last`` into ``path``; gives the log. Finished rounds are not repeated.

    ``start`` has cand_id, text and what ``label`` needs; ``vary(survivors, t)`` gives the variations
    of a round's survivors with new cand_ids and the same columns. ``judge`` labels survivors for the metrics, which compare them
    with ``reference``. With ``s.prior`` the metrics of a sample of the start are round -1 of the log.
    """
    spark = start.sparkSession
    done = _finished(spark, f"{path}/log")
    keep = start.columns
    measured = (lambda d: diverge(embed(d))) if diverge is not None else None
    if done <= s.last:  # every round reads both several times
        voters, named = written(voters), [c for c in dict.fromkeys([*s.attributes, *s.blind, s.by]) if c in target.columns]
        target = written(target.select(*named))
    if s.prior and not _finished(spark, f"{path}/prior"):
        first = drawn(start.where(has_text(F.col("text"))), F.col("cand_id"), s.prior, 10_000 + s.seed)
        first = labelled(first, judge or label, s.attributes, "eval_")
        first = first.withColumns({f"loop_{a}": F.col(f"eval_{a}") for a in s.blind})
        append_log(round_metrics(first, target, s, -1, reference, measured), f"{path}/prior")
    for t in range(done, s.last + 1):
        if t == 0:
            candidates = start
        else:
            survivors = spark.read.parquet(f"{path}/rounds/round={t - 1}").select(*keep)
            candidates = survivors.unionByName(vary(survivors, t).select(*keep))
        with temporary_tables():
            write_round(one_round(candidates, voters, target, s, t, embed, label, judge).drop("vector"), f"{path}/rounds", t)
        chosen = spark.read.parquet(f"{path}/rounds/round={t}")
        append_log(round_metrics(chosen, target, s, t, reference, measured), f"{path}/log")
    if done <= s.last:
        forget(voters)
        forget(target)
    log = spark.read.json(f"{path}/log")
    return prior_as_round(spark.read.json(f"{path}/prior").drop("round"), log) if s.prior else log


def sweep(runs: Mapping[str, Settings], path: str, go: Callable[[Settings, str], DataFrame]) -> DataFrame:
    """The logs of a grid of settings by run name (such as annotator/lam0.5_seed1), with ``run``; each run has its own folder and resumes."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (go(s, f"{path}/{name}").withColumn("run", F.lit(name)) for name, s in runs.items()))


def grid(annotators: Sequence[str], strengths: Sequence[float], seeds: Sequence[int], settings: Settings) -> dict[str, Settings]:
    """Run name -> settings of every annotator, strength and seed; the name is the run's folder."""
    return {f"{a}/lam{lam:g}_seed{seed}": replace(settings, strength=lam, seed=seed) for a in annotators for lam in strengths for seed in seeds}


def _finished(spark, path: str) -> int:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return 0
    return spark.read.text(path).count()


def variations(survivors: DataFrame, times: int, t: int, change: Callable[[DataFrame], DataFrame], first_id: int) -> DataFrame:
    """``times`` copies of every survivor, each with a new id from its parent's, passed through ``change``."""
    copies = survivors.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    fresh = F.lit(first_id) + F.pmod(F.xxhash64("cand_id", "copy", F.lit(t)), F.lit(1 << 52))
    return change(copies.withColumn("cand_id", fresh)).drop("copy")


def service_annotator(vocabulary: Vocabulary, attributes: Sequence[str], call: Callable[[str], str], instruction: str, cache: str, model: str) -> Transform:
    """An annotator that asks a service once per distinct text, through a cache, and cleans its answers.

    An answer without any label leaves all of them null; a single missing one takes its fallback.
    """
    options = {a: vocabulary.options[a] for a in attributes}

    def asked(texts: DataFrame) -> DataFrame:
        answered = ask(texts.withColumn("_prompt", label_prompt(options, F.col("text"), instruction)), "_prompt", call)
        return answered.withColumn("_v", parse_labels(F.col("answer"), attributes)).select("_key", "text", *(F.col(f"_v.{a}").alias(f"map_{a}") for a in attributes), "error")

    def label(df: DataFrame) -> DataFrame:
        got = labels_from_map(through_cache(df, cache, asked, model), vocabulary, attributes)
        return got.drop(*attributes, "error").withColumnsRenamed({f"map_{a}": a for a in attributes})

    return label


def classifier_annotator(models: Mapping[str, Transform], vocabulary: Vocabulary, attributes: Sequence[str]) -> Transform:
    """An annotator of carried labels in which a classifier, a function that adds ``prediction_label``, replaces those of its attribute."""

    def label(df: DataFrame) -> DataFrame:
        out = inherited_labels(df, vocabulary, attributes)
        for a, predict in models.items():
            known = clean_value(F.col("prediction_label"), vocabulary.options[a], vocabulary.fallback[a])
            out = predict(out).withColumn(a, known).drop("prediction_label")
        return out

    return label


class AnnotatorRegistry:
    """Annotators by name: functions from a frame to the frame with labels."""

    def __init__(self, known: Mapping[str, Transform] | None = None):
        self.known = dict(known or {})

    def register(self, name: str, label: Transform) -> None:
        self.known[name] = label

    def label(self, name: str, df: DataFrame) -> DataFrame:
        if name not in self.known:
            raise KeyError(f"unknown annotator {name}; there are {sorted(self.known)}")
        return self.known[name](df)
