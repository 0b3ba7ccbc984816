"""Queries of paths, answers and small table operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashrng import normal, normal_sql, uniform_sql
from ..functions.labels import cyclic, length_bin, word_count
from ..operators.rankstats import fisher_z, leave_one_out, spearman
from ..operators.selection import top_k
from ..operators.splits import length_matched
from ..sources.connectors import answer_counts as count_answers
from ..sources.connectors import in_vocabulary, model_tag
from ..sources.runlog import budget_fields, keep_last, no_nan, run_folders as folders_of_runs
from ..sources.runlog import two_methods
from ..sources.sinks import json_lines as as_json
from ..sources.tables import first_rows as first_of
from ..sources.tables import with_variations
from . import data
from .catalog import query
from .labels_queries import _rounded
from .selection_queries import CAND_SQL, candidates
from .splits_queries import _W
from .statistics_queries import _XY, _rank, _xy

# The test log has no folder of a budget and no run of the plain method; its paths are put under such folders.

_EPS = "'eps' || (CASE WHEN moved % 2 = 0 THEN '4.0' ELSE '1.0' END) || '/' || log_path"
_SWEEP = "([^/]+)/lam([0-9.]+)(?:_seed([0-9]+))?/[^/]+$"


@query(f"""WITH d AS (SELECT {_EPS} AS p, round, mauve, logged_at FROM run_log WHERE moved IS NOT NULL AND NOT isnan(coalesce(mauve, 0))), f AS (SELECT regexp_extract(p, '^eps([^/]+)/', 1) AS eps, regexp_extract(p, '{_SWEEP}', 1) AS annotator,
rtrim(regexp_extract(p, '{_SWEEP}', 2), '.')::DOUBLE AS lam, coalesce(nullif(regexp_extract(p, '{_SWEEP}', 3), ''), '0')::INTEGER AS seed, round, mauve, logged_at FROM d WHERE regexp_matches(p, '^eps[^/]+/{_SWEEP}'))
SELECT eps, annotator, lam, seed, round, round(mauve, 6) AS mauve FROM f QUALIFY row_number() OVER (PARTITION BY eps, annotator, lam, seed ORDER BY round DESC, logged_at DESC NULLS LAST, coalesce(mauve, -1) DESC) = 1""")
def budget_last_round(spark, sf_dir):
    """The last round of every run of every budget, with the budget from the path."""
    eps = F.concat(F.lit("eps"), F.when(F.col("moved") % 2 == 0, "4.0").otherwise("1.0"), F.lit("/"), F.col("log_path"))
    log = data.table(spark, sf_dir, "run_log").where("moved is not null and not isnan(coalesce(mauve, 0))").withColumn("log_path", eps)
    d = budget_fields(log, "log_path").select("eps", "annotator", "lam", "seed", "round", "mauve", "logged_at")
    last = keep_last(d, ["eps", "annotator", "lam", "seed"], [F.col("round"), F.col("logged_at"), F.coalesce("mauve", F.lit(-1.0))])
    return _rounded(last.drop("logged_at"))


_PLAIN = "regexp_replace(log_path, '^.*/lam1(\\.0)?(_seed([0-9]+))?/', 'runs/seed\\3/')"


@query(f"""WITH a AS (SELECT 'plain' AS method, regexp_extract(p, 'seed([0-9]+)/', 1)::INTEGER AS seed, round, moved FROM (SELECT {_PLAIN} AS p, round, moved FROM run_log WHERE regexp_matches(log_path, '/lam1(\\.0)?_seed[0-9]+/')) WHERE regexp_matches(p, '(^|/)seed[0-9]+/[^/]+$')),
b AS (SELECT 'sweep' AS method, coalesce(nullif(regexp_extract(log_path, 'lam0(\\.0)?_seed([0-9]+)/', 2), ''), '0')::INTEGER AS seed, round, moved FROM run_log WHERE regexp_matches(log_path, '(^|/)lam0(\\.0)?(_seed[0-9]+)?/[^/]+$'))
SELECT method, seed, round, moved FROM a UNION ALL SELECT method, seed, -1, NULL FROM a WHERE round = 0 UNION ALL SELECT method, seed, round, moved FROM b""")
def two_methods_rounds(spark, sf_dir):
    """Rounds of the plain method, its prior as round -1, and of the sweep at strength 0; lam0.25 and the like are left out."""
    log = data.table(spark, sf_dir, "run_log").select("log_path", "round", "moved")
    path = F.regexp_replace("log_path", r"^.*/lam1(\.0)?(_seed([0-9]+))?/", "runs/seed$3/")
    plain = log.where(F.col("log_path").rlike(r"/lam1(\.0)?_seed[0-9]+/")).withColumn("log_path", path)
    return two_methods(plain, log, plain.where("round = 0").select("log_path")).select("method", "seed", "round", "moved")


@query("SELECT DISTINCT regexp_replace(log_path, '/[^/]*$', '') AS folder FROM run_log WHERE regexp_matches(log_path, '(^|/)(lam[0-9.]+(_seed[0-9]+)?|seed[0-9]+)/[^/]*$')")
def run_folders(spark, sf_dir):
    """Folders that are named as runs are."""
    return folders_of_runs(data.table(spark, sf_dir, "run_log"))


@query("SELECT annotator, list_last(string_split(rtrim(annotator_kind || '/' || annotator || '/', '/'), '/')) AS tag FROM annotators")
def model_tags(spark, sf_dir):
    """The last part of every annotator's path."""
    path = F.concat_ws("/", "annotator_kind", "annotator", F.lit(""))
    return data.table(spark, sf_dir, "annotators").select("annotator", model_tag(path).alias("tag"))


_MAPS = ("map_primary_research_area", "map_dominant_data_type", "map_sample_size")


@query(f"SELECT annotator, count(*) AS answers, 0::BIGINT AS errors, count(*) FILTER ({' AND '.join(f'{m} IS NULL' for m in _MAPS)}) AS unparsed, {', '.join(f'round(avg(({m} IS NOT NULL)::INTEGER), 6) AS {m}' for m in _MAPS)} FROM train_annotations GROUP BY annotator")
def answer_counts(spark, sf_dir):
    """Answers, those without any label, and the share with each label, by annotator."""
    return _rounded(count_answers(data.table(spark, sf_dir, "train_annotations"), _MAPS, ["annotator"]))


@query(data.ctes(data.VOCAB_SQL) + "SELECT annotation_id, " + ", ".join(f"CASE WHEN list_contains((SELECT opts FROM vocab WHERE attr = '{m[4:]}'), {m}) THEN {m} END AS {m[4:]}" for m in _MAPS) + " FROM train_annotations")
def answers_in_vocabulary(spark, sf_dir):
    """Labels of every annotation that are options; others are null."""
    options = {m[4:]: data.vocabulary(spark, sf_dir).options[m[4:]] for m in _MAPS}
    d = data.table(spark, sf_dir, "train_annotations")
    own = in_vocabulary(F.struct(*(F.col(m).alias(m[4:]) for m in _MAPS)), options)
    return d.select("annotation_id", own.alias("v")).select("annotation_id", "v.*")


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100")
def first_rows(spark, sf_dir):
    """The hundred documents of the smallest ids."""
    return first_of(data.table(spark, sf_dir, "documents").select("doc_id", "source"), 100, "doc_id")


@query(data.ctes(data.PRIVATE_SQL, data.POOL_SQL, f"q AS (SELECT row_id, {_W} AS bin FROM pool1)", f"p AS (SELECT {_W} AS bin FROM private)") + f""", pb AS (SELECT bin, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM p GROUP BY 1), qb AS (SELECT bin, count(*) AS nq FROM q GROUP BY 1),
b AS (SELECT bin, nq, share / sum(share) OVER () AS w FROM pb JOIN qb USING (bin)), m AS (SELECT *, floor(round(min(nq / w) OVER (), 9)) AS m FROM b), k AS (SELECT bin, least(round_even(round(m * w, 9), 0), nq) AS k FROM m),
c AS (SELECT row_id, bin FROM (SELECT q.*, k, row_number() OVER (PARTITION BY bin ORDER BY {uniform_sql(0, 'length', 'row_id')}, row_id) AS r FROM q JOIN k USING (bin)) WHERE r <= k)
SELECT row_id, bin FROM c ORDER BY {uniform_sql(0, 'match', 'row_id')}, row_id LIMIT 50""")
def length_matched_n(spark, sf_dir):
    """50 of the pool rows whose lengths follow those of the private texts."""
    bin_ = length_bin(word_count(F.coalesce("text", F.lit("")))).alias("bin")
    q, p = data.pool(spark, sf_dir, "text").select("row_id", bin_), data.private(spark, sf_dir, "text").select(bin_)
    return length_matched(q, p, "row_id", "bin", n=50).select("row_id", "bin")


_NOISE = ", ".join(normal_sql(0, "cycle", str(k)) for k in range(7))


@query(f"SELECT vec_id, round(([{_NOISE}])[(vec_id % 7) + 1], 6) AS noise, label + 3 AS entries FROM embeddings")
def cyclic_noise(spark, sf_dir):
    """Seven normal draws repeated over all vectors by id, and repeated arrays of other lengths."""
    noise = F.array(*(normal(0, "cycle", F.lit(k)) for k in range(7)))
    d = data.table(spark, sf_dir, "embeddings").select("vec_id", "label", noise.alias("n"))
    at = F.get(cyclic(F.col("n"), F.lit(49)), (F.col("vec_id") % 7 + 7 * (F.col("label") % 7)).cast("int"))
    return d.select("vec_id", F.round(at, 6).alias("noise"), F.size(cyclic(F.col("n"), (F.col("label") + 3).cast("int"))).alias("entries"))


@query("""SELECT log_path, round, '{"log_path":"' || log_path || '","round":' || round || (CASE WHEN moved IS NULL THEN '' ELSE ',"moved":' || moved END) || '}' AS line FROM run_log""")
def json_lines(spark, sf_dir):
    """Log lines as JSON objects."""
    return data.table(spark, sf_dir, "run_log").select("log_path", "round", as_json(["log_path", "round", "moved"]).alias("line"))


@query(data.ctes(*CAND_SQL, "top AS (SELECT cand_id FROM (SELECT cand_id, row_number() OVER (ORDER BY score DESC, cand_id) AS r FROM cand), kk WHERE r <= k)") + "SELECT cand_id, unnest(range(-1, 6))::INTEGER AS copy FROM top")
def survivors_and_variations(spark, sf_dir):
    """The survivors and six variations of each: the next round's candidates."""
    cand, _, k = candidates(spark, sf_dir)
    return with_variations(top_k(cand.select("cand_id", "score"), k).select("cand_id"), 6)


@query(data.ctes(*_XY) + f", o AS (SELECT o.attr AS left_out, xy.x, xy.y FROM xy, xy o WHERE o.attr <> xy.attr), a AS (SELECT count(*) AS n, corr(rx, ry) AS rho FROM (SELECT {_rank('x')} AS rx, {_rank('y')} AS ry FROM xy)), l AS (SELECT left_out, count(*) AS n, corr(rx, ry) AS rho FROM (SELECT left_out, {_rank('x', by='left_out')} AS rx, {_rank('y', by='left_out')} AS ry FROM o) GROUP BY left_out) SELECT left_out, CASE WHEN a.n >= 4 AND l.n >= 4 AND abs(a.rho) < 1 AND abs(l.rho) < 1 THEN round((atanh(a.rho) - atanh(l.rho)) / sqrt(1.0::DOUBLE / greatest(a.n - 3, 1) + 1.0::DOUBLE / greatest(l.n - 3, 1)), 5) END AS z FROM a, l")
def fisher_difference_z(spark, sf_dir):
    """Standardised difference of the whole rank correlation and that without each attribute."""
    d = _xy(spark, sf_dir)
    whole = spearman(d, "x", "y").select(F.col("n").alias("n1"), F.col("rho").alias("r1"))
    both = leave_one_out(d, "attr", "x", "y").crossJoin(F.broadcast(whole))  # one row
    return both.select("left_out", F.round(fisher_z(F.col("r1"), F.col("n1"), F.col("rho"), F.col("n")), 5).alias("z"))
