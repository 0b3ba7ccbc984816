"""Queries of the run-log family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.report import (
    best_model, best_of, change_first_last, family, final_table, is_baseline, mean_sd_n, paired_differences,
    paired_with_fallback, pivot_first, replicate_baseline, unpivot, visibility_summary,
)
from ..sources.runlog import join_side_file, last_round, path_fields, prior_as_round
from ..sources.sinks import mean_sd, signed_ci
from . import data
from .catalog import query
from .labels_queries import _rounded

RUN = ["annotator", "lam", "seed"]
_M = data.METRICS
_LAST = "last AS (SELECT * FROM logs QUALIFY row_number() OVER (PARTITION BY annotator, lam, seed ORDER BY round DESC) = 1)"
_SEEDS = [_LAST, f"seeds AS (SELECT annotator, lam, seed % 4 AS seed, {', '.join(f'avg({m}) AS {m}' for m in _M)} FROM last GROUP BY ALL)"]
_UNPIVOT = "({})".format(" UNION ALL ".join(f"SELECT *, '{m}' AS metric, {m} AS value FROM {{src}} WHERE coalesce(NOT isnan({m}), false)" for m in _M))


def _seeds(spark, sf_dir):
    """Last rounds averaged over runs whose seeds agree modulo 4, as the test log never repeats a seed."""
    last = last_round(data.run_log(spark, sf_dir), RUN)
    return last.groupBy("annotator", "lam", (F.col("seed") % 4).alias("seed")).agg(*(F.avg(m).alias(m) for m in _M))


@query(data.ctes(data.RUNLOG_SQL) + f"SELECT annotator, lam, seed, round, {', '.join(_M)}, moved, shortfall FROM logs")
def dedupe_keep_last(spark, sf_dir):
    """The last line of every round, with the settings of its path and NaN as null."""
    return data.run_log(spark, sf_dir).select(*RUN, "round", *_M, "moved", "shortfall")


@query("SELECT log_path, round, regexp_extract(log_path, '([^/]+)/lam', 1) AS annotator, CASE WHEN log_path LIKE '%\\_seed%' ESCAPE '\\' THEN regexp_extract(log_path, '_seed([0-9]+)/', 1)::INTEGER ELSE 0 END AS seed FROM run_log WHERE regexp_matches(log_path, '([^/]+)/lam([0-9.]+)(?:_seed([0-9]+))?/[^/]+$')")
def path_settings(spark, sf_dir):
    """Settings in the path of every log line; other paths drop out."""
    return path_fields(data.table(spark, sf_dir, "run_log"), "log_path").select("log_path", "round", "annotator", "seed")


@query(data.ctes(data.RUNLOG_SQL, _LAST) + "SELECT annotator, lam, seed, round, mauve, jsd_mean FROM last")
def last_round_per_run(spark, sf_dir):
    """The last round of each run."""
    return last_round(data.run_log(spark, sf_dir), RUN).select(*RUN, "round", "mauve", "jsd_mean")


_FAMILY = "CASE WHEN contains(annotator, '-') THEN regexp_extract(annotator, '^[^-]*-(.*)$', 1) ELSE '' END"
_REPL = f"""f AS (SELECT *, {_FAMILY} AS fam, starts_with(annotator, 'maple') AS is_base FROM logs), mem AS (SELECT DISTINCT fam, annotator AS m FROM f WHERE NOT is_base),
repl AS (SELECT annotator, lam, seed, round, jsd_mean FROM f WHERE NOT (is_base AND lam = 0) UNION ALL SELECT coalesce(m, annotator), lam, seed, round, jsd_mean FROM f LEFT JOIN mem USING (fam) WHERE is_base AND lam = 0)"""


@query(data.ctes(data.RUNLOG_SQL, _REPL) + "SELECT annotator, lam, seed, round, jsd_mean FROM repl")
def baseline_replicated(spark, sf_dir):
    """A family's baseline at strength 0 under every annotator of the family."""
    return replicate_baseline(data.run_log(spark, sf_dir).select(*RUN, "round", "jsd_mean"), data.BASELINE)


@query("SELECT DISTINCT annotator, fam AS family, starts_with(annotator, 'maple') AS baseline FROM (SELECT regexp_extract(log_path, '([^/]+)/lam', 1) AS annotator FROM run_log WHERE regexp_matches(log_path, '([^/]+)/lam([0-9.]+)(?:_seed([0-9]+))?/[^/]+$')), LATERAL (SELECT CASE WHEN contains(annotator, '-') THEN regexp_extract(annotator, '^[^-]*-(.*)$', 1) ELSE '' END AS fam)")
def annotator_families(spark, sf_dir):
    """Family of every annotator, and whether it is a baseline."""
    d = path_fields(data.table(spark, sf_dir, "run_log"), "log_path").select("annotator").distinct()
    return d.select("annotator", family(F.col("annotator")).alias("family"), is_baseline(F.col("annotator"), data.BASELINE).alias("baseline"))


def _agg_sql(source: str, by: str) -> str:
    return f"SELECT {by}, avg(value) AS mean, stddev_samp(value) AS sd, count(value) AS n FROM {source} GROUP BY {by}"


def _rounded_sql(by: str, agg: str) -> str:
    return f"SELECT {by}, round(mean, 6) AS mean, round(sd, 6) AS sd, n, round({data.interval_sql('sd', 'n')}, 6) AS ci95 FROM ({agg})"


@query(data.ctes(data.RUNLOG_SQL, *_SEEDS, data.t_table_sql()) + f", base AS (SELECT annotator, seed, {', '.join(f'{m} AS {m}_ref' for m in _M)} FROM seeds WHERE lam = 0), d AS (SELECT annotator, lam, {', '.join(f'{m} - {m}_ref AS {m}' for m in _M)} FROM seeds JOIN base USING (annotator, seed) WHERE lam > 0) "
    + _rounded_sql("annotator, lam, metric", _agg_sql(_UNPIVOT.format(src="d"), "annotator, lam, metric")))
def paired_vs_lambda0(spark, sf_dir):
    """Differences of last rounds to strength 0 of the same annotator and seed."""
    last = _seeds(spark, sf_dir)
    return _rounded(paired_differences(last.where("lam > 0"), last.where("lam = 0"), ["annotator", "seed"], ["annotator", "lam"], _M))


@query(data.ctes(data.RUNLOG_SQL, *_SEEDS, data.t_table_sql()) + """, b AS (SELECT * FROM seeds WHERE starts_with(annotator, 'maple')), r AS (SELECT * FROM seeds WHERE NOT starts_with(annotator, 'maple')), any_ AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY lam, seed ORDER BY annotator) = 1),
d AS (SELECT r.annotator, r.lam, r.jsd_mean - a.jsd_mean AS jsd_mean, r.mauve - a.mauve AS mauve FROM r JOIN any_ a USING (lam, seed)), u AS (SELECT annotator, lam, 'jsd_mean' AS metric, jsd_mean AS value FROM d WHERE jsd_mean IS NOT NULL UNION ALL SELECT annotator, lam, 'mauve', mauve FROM d WHERE mauve IS NOT NULL) """
    + _rounded_sql("annotator, lam, metric", _agg_sql("u", "annotator, lam, metric")))
def paired_family(spark, sf_dir):
    """Differences to a baseline of the same name, strength and seed, or else to any baseline of the same strength and seed."""
    last = _seeds(spark, sf_dir)
    base = is_baseline(F.col("annotator"), data.BASELINE)
    return _rounded(paired_with_fallback(last.where(~base), last.where(base), RUN, ["lam", "seed"], "annotator", ["annotator", "lam"], ["jsd_mean", "mauve"]))


@query(data.ctes(data.RUNLOG_SQL, _LAST) + f"SELECT annotator, lam, count(DISTINCT seed) AS seeds, round(avg(round), 6) AS round, {', '.join(f'round(avg({m}), 6) AS {m}, round(stddev_samp({m}), 6) AS {m}_sd' for m in _M)} FROM last GROUP BY annotator, lam")
def final_mean_sd_n(spark, sf_dir):
    """Means and deviations of the last rounds over seeds."""
    return _rounded(final_table(last_round(data.run_log(spark, sf_dir), RUN), ["annotator", "lam"], _M))


@query(data.ctes(data.RUNLOG_SQL, data.t_table_sql()) + _rounded_sql("annotator, lam, round, metric", _agg_sql(_UNPIVOT.format(src="logs"), "annotator, lam, round, metric")))
def by_round_unpivot(spark, sf_dir):
    """Mean, deviation, number and interval of every metric by round."""
    long = unpivot(data.run_log(spark, sf_dir), [*RUN, "round"], _M)
    return _rounded(mean_sd_n(long, ["annotator", "lam", "round", "metric"]))


@query(data.ctes(data.RUNLOG_SQL, data.t_table_sql()) + f""", u AS {_UNPIVOT.format(src='logs')}, s AS (SELECT annotator, lam, metric, seed, min(round) AS a, count(DISTINCT round) AS k, arg_max(value, round) - arg_min(value, round) AS value FROM u GROUP BY ALL),
g AS ({_agg_sql('(SELECT * FROM s WHERE a = 0 AND k >= 2)', 'annotator, lam, metric')}), i AS (SELECT *, {data.interval_sql('sd', 'n')} AS ci FROM g)
SELECT annotator, lam, metric, round(mean, 6) AS mean, round(sd, 6) AS sd, n, round(ci, 6) AS ci95, CASE WHEN n < 2 THEN 'n<2' WHEN abs(mean) <= ci THEN 'n.s.' WHEN mean > 0 THEN 'up' ELSE 'down' END AS verdict FROM i""")
def change_first_last_rounds(spark, sf_dir):
    """Change from round 0 to the last round per seed, with a verdict."""
    long = unpivot(data.run_log(spark, sf_dir), [*RUN, "round"], _M)
    return _rounded(change_first_last(long, ["annotator", "lam", "metric"], ["seed"], 0))


@query(data.ctes(data.RUNLOG_SQL) + ", p AS (SELECT annotator, lam, seed, min(jsd_mean) FILTER (round = 0) AS round_0, min(jsd_mean) FILTER (round = 1) AS round_1, min(jsd_mean) FILTER (round = 3) AS round_3 FROM logs GROUP BY ALL) SELECT annotator, lam, seed, round(round_0, 6) AS round_0, round(round_1, 6) AS round_1, round(round_3, 6) AS round_3 FROM p WHERE round_0 + round_1 + round_3 IS NOT NULL")
def pivot_rounds(spark, sf_dir):
    """One column per round; runs that lack one drop out."""
    d = data.run_log(spark, sf_dir).withColumn("column", F.concat(F.lit("round_"), F.col("round").cast("string")))
    return _rounded(pivot_first(d, RUN, "column", ["round_0", "round_1", "round_3"], "jsd_mean"))


@query(data.ctes(data.RUNLOG_SQL, _LAST) + """, a AS (SELECT annotator, lam, round(avg(mauve), 9) AS v FROM last WHERE mauve IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY annotator ORDER BY v DESC, lam) AS r FROM a)
SELECT annotator, max(lam) FILTER (r = 1) AS best, round(max(v) FILTER (r = 1), 6) AS best_value, round(max(v) FILTER (r = 1) - max(v) FILTER (r = 2), 6) AS gap FROM r GROUP BY annotator""")
def best_of_columns(spark, sf_dir):
    """The best strength of every annotator and its lead."""
    last = last_round(data.run_log(spark, sf_dir), RUN).where("mauve is not null")
    return _rounded(best_of(last.groupBy("annotator", "lam").agg(F.round(F.avg("mauve"), 9).alias("v")), ["annotator"], "lam", "v"))


@query(data.ctes(data.RUNLOG_SQL, _LAST) + ", a AS (SELECT lam, annotator, round(avg(mauve), 3) AS score, length(annotator) AS cost FROM last WHERE mauve IS NOT NULL GROUP BY 1, 2) SELECT lam, annotator, score FROM a WHERE annotator IN (SELECT annotator FROM logs WHERE round >= 3) QUALIFY row_number() OVER (PARTITION BY lam ORDER BY score DESC, cost, annotator) = 1")
def best_model_per_attr(spark, sf_dir):
    """The best annotator of every strength that has run three rounds, ties by cost."""
    log = data.run_log(spark, sf_dir)
    a = last_round(log, RUN).where("mauve is not null").groupBy("lam", "annotator").agg(F.round(F.avg("mauve"), 3).alias("score"))
    a = a.withColumn("cost", F.struct(F.length("annotator"), F.col("annotator")))
    return best_model(a, ["lam"], "score", "cost", log.where("round >= 3").select("annotator")).select("lam", "annotator", "score")


@query(data.ctes(data.RUNLOG_SQL, _LAST, data.t_table_sql()) + f", g AS ({_agg_sql('(SELECT annotator, lam, jsd_mean AS value FROM last WHERE jsd_mean IS NOT NULL)', 'annotator, lam')}) SELECT annotator, lam, printf('%.3f ± %.3f', mean, coalesce(sd, 0)) AS cell, printf('%+.3f ± %.3f (n=%d)', mean, {data.interval_sql('sd', 'n')}, n) AS signed FROM g WHERE n > 1")
def report_cells(spark, sf_dir):
    """Cells of a report: mean ± sd, and mean ± interval with the number of seeds."""
    last = last_round(data.run_log(spark, sf_dir), RUN)
    g = mean_sd_n(last.select("annotator", "lam", F.col("jsd_mean").alias("value")).where("value is not null"), ["annotator", "lam"]).where("n > 1")
    return g.select("annotator", "lam", mean_sd("mean", "sd", 3).alias("cell"), signed_ci("mean", "ci95", "n", 3).alias("signed"))


@query(data.ctes(data.RUNLOG_SQL) + ", side AS (SELECT annotator, lam, seed, round, shortfall AS mauve_short, moved FROM logs WHERE shortfall > 5) SELECT l.annotator, l.lam, l.seed, l.round, l.mauve, s.mauve_short FROM logs l LEFT JOIN side s USING (annotator, lam, seed, round)")
def side_file_merge(spark, sf_dir):
    """A side file's columns, matched by round; rounds without one have nulls."""
    logs = data.run_log(spark, sf_dir)
    side = logs.where("shortfall > 5").select(*RUN, "round", F.col("moved").alias("line_no"), F.col("shortfall").alias("mauve_short"))
    return join_side_file(logs.select(*RUN, "round", "mauve"), side, [*RUN, "round"])


@query(data.ctes(data.RUNLOG_SQL) + "SELECT annotator, seed, -1 AS round, jsd_mean, NULL::DOUBLE AS mauve FROM logs WHERE round = 0 AND lam = 0 UNION ALL SELECT annotator, seed, round, jsd_mean, mauve FROM logs WHERE lam = 0")
def prior_round(spark, sf_dir):
    """Metrics of a prior sample as round -1."""
    logs = data.run_log(spark, sf_dir).where("lam = 0")
    return prior_as_round(logs.where("round = 0").select("annotator", "seed", "jsd_mean"), logs.select("annotator", "seed", "round", "jsd_mean", "mauve")).select("annotator", "seed", "round", "jsd_mean", "mauve")


@query(data.ctes(data.RUNLOG_SQL) + """, r AS (SELECT annotator AS attr, seed AS repeat, jsd_mean AS knn, mauve AS probe FROM logs WHERE round = 0), g AS (SELECT attr, avg(knn) AS knn, stddev_samp(knn) AS knn_sd, avg(probe) AS probe, stddev_samp(probe) AS probe_sd FROM r GROUP BY attr), c AS (SELECT annotator AS attr, count(DISTINCT lam) AS n_classes FROM logs GROUP BY 1)
SELECT attr, n_classes, round(knn, 6) AS knn, round(knn_sd, 6) AS knn_sd, round(probe, 6) AS probe, round(probe_sd, 6) AS probe_sd, round(probe - knn, 6) AS gap, round(1 - knn, 6) AS blindness, row_number() OVER (ORDER BY attr <> 'inherited' DESC, 1 - knn DESC, attr) <= 3 AND attr <> 'inherited' AS selected FROM g JOIN c USING (attr)""")
def exp1_summary(spark, sf_dir):
    """Visibility by k-NN and probe over repeats, the gap, and the attributes that are seen least."""
    log = data.run_log(spark, sf_dir)
    per = log.where("round = 0").select(F.col("annotator").alias("attr"), F.col("seed").alias("repeat"), F.col("jsd_mean").alias("knn"), F.col("mauve").alias("probe"))
    classes = log.groupBy(F.col("annotator").alias("attr")).agg(F.count_distinct("lam").alias("n_classes"))
    return _rounded(visibility_summary(per, classes, 3, ["inherited"]))
