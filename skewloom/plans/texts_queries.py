"""Queries of the text family."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.histograms import bin_among, decile_edges, length_weights
from ..functions.labels import length_bin, word_count
from . import data
from .catalog import query
from .labels_queries import _BIN, _WORDS, _rounded

# The features' SQL is written from their definitions, in another regular-expression dialect, not from the operator's patterns.
_SPACE = "[ \\t\\n\\x0b\\f\\r\\x{1c}-\\x{1f}\\x{85}\\p{Z}]"
_WHITE = f"list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda x: x <> '')"
_NUMBER = "[0-9][0-9.,]*"
_COUNT = "len(regexp_extract_all(t, '{}'))"
_HEDGES = "(?i)\\b(may|might|could|possibly|potentially|likely|unlikely|suggest[0-9a-z_]*|indicat[0-9a-z_]*|appear[0-9a-z_]*|putative[0-9a-z_]*)\\b"
_FIRST = "(?i)\\b(we|our|us|ours)\\b"
_PASSIVE = "(?i)\\b(is|are|was|were|be|been|being)\\s+([0-9a-z_]+ly\\s+)?[0-9a-z_]+ed\\b"
_ACRONYM = "\\b[A-Z][A-Z][A-Za-z0-9-]*\\b"
_STATISTIC = ("(?i)\\bp\\s*[<=>]\\s*0?\\.[0-9]", "[0-9]\\s*%", "±", "(?i)\\bci\\b", "(?i)confidence interval", "(?i)\\b(odds|hazard) ratio\\b")
_SOURCE = "src AS (SELECT row_id, text AS t FROM pool WHERE text IS NOT NULL)"
_BASE = f"""{_SOURCE}, tok AS (SELECT *, regexp_extract_all(t, '[A-Za-z][A-Za-z''-]*|{_NUMBER}') AS w FROM src),
    b AS (SELECT *, len(w) AS n, greatest(len(w), 1) AS d, list_filter(w, lambda x: regexp_matches(x, '^[A-Za-z]')) AS alpha, len({_WHITE}) AS white,
    len(regexp_extract_all(regexp_replace(t, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '[.!?]{_SPACE}+[A-Z(]')) + 1 AS s FROM tok)"""
_LOW = "list_transform(w, lambda x: lower(x))"
_MATTR = f"""CASE WHEN n <= 50 THEN len(list_distinct({_LOW}))::DOUBLE / d
    ELSE list_avg(list_transform(range(0, n - 49, 5), lambda i: len(list_distinct(list_slice({_LOW}, (i + 1)::BIGINT, (i + 50)::BIGINT))) / 50.0::DOUBLE)) END"""
_FEATURE_SQL = {
    "mean_sentence_length": "d::DOUBLE / s",
    "numeric_rate": "(n - len(alpha))::DOUBLE / d",
    "has_statistic": "(" + " OR ".join(f"regexp_matches(t, '{x}')" for x in _STATISTIC) + ")::INTEGER",
    "hedge_rate": f"{_COUNT.format(_HEDGES)}::DOUBLE / d",
    "first_person_rate": f"{_COUNT.format(_FIRST)}::DOUBLE / d",
    "moving_ttr": _MATTR,
    "mean_word_length": "coalesce(len(array_to_string(alpha, ''))::DOUBLE / nullif(len(alpha), 0), 0)",
    "acronym_rate": f"{_COUNT.format(_ACRONYM)}::DOUBLE / d",
    "passive_per_sentence": f"{_COUNT.format(_PASSIVE)}::DOUBLE / s",
    "word_count": "white::INTEGER",
}


def _features_sql(*names: str) -> str:
    columns = ", ".join(f"{_FEATURE_SQL[n]} AS {n}" if n in ("word_count", "has_statistic") else f"round({_FEATURE_SQL[n]}, 6) AS {n}" for n in names)
    return f"WITH {_BASE} SELECT row_id, {columns} FROM b"


def _texts(spark, sf_dir):
    return data.table(spark, sf_dir, "pool").where("text is not null").select("row_id", "text")


_LENGTHS = ("word_count", "mean_sentence_length", "numeric_rate", "mean_word_length")
_RATES = ("has_statistic", "hedge_rate", "first_person_rate", "acronym_rate", "passive_per_sentence")


@query(_features_sql(*_LENGTHS))
def surface_features(spark, sf_dir):
    """Lengths and numeric rate of every pool text."""
    f = T.features(F.col("text"))
    return _rounded(_texts(spark, sf_dir).select("row_id", *(f[c].alias(c) for c in _LENGTHS)))


@query(_features_sql("moving_ttr"))
def mattr(spark, sf_dir):
    """Moving type-token ratio of every pool text."""
    return _rounded(_texts(spark, sf_dir).select("row_id", T.features(F.col("text"))["moving_ttr"].alias("moving_ttr")))


@query(_features_sql(*_RATES))
def regex_rates(spark, sf_dir):
    """Rates of hedges, first persons, acronyms, passives and statistics."""
    f = T.features(F.col("text"))
    return _rounded(_texts(spark, sf_dir).select("row_id", *(f[c].alias(c) for c in _RATES)))


_Q = "[" + ", ".join(f"{k / 10}" for k in range(1, 10)) + "]"


@query(f"""WITH x AS (SELECT 'orders' AS feature, o_totalprice AS x FROM orders UNION ALL SELECT 'lines', l_extendedprice FROM lineitem UNION ALL SELECT 'quantity', l_quantity FROM lineitem),
e AS (SELECT feature, list_sort(list_distinct(quantile_cont(x::DOUBLE, {_Q}::DOUBLE[]))) AS edges FROM x GROUP BY feature) SELECT feature, len(list_filter(edges, lambda e: e <= x))::INTEGER AS bin, count(*) AS n FROM x JOIN e USING (feature) GROUP BY ALL""")
def decile_hist(spark, sf_dir):
    """Histograms on distinct deciles of three measures."""
    counts = []
    for name, columns in (("orders", {"orders": "o_totalprice"}), ("lineitem", {"lines": "l_extendedprice", "quantity": "l_quantity"})):
        d = data.table(spark, sf_dir, name).select(*(F.col(c).alias(f) for f, c in columns.items()))
        edges = decile_edges(d, list(columns))
        for f in columns:
            counts.append(d.where(F.col(f).isNotNull()).groupBy(bin_among(F.col(f), edges[f]).alias("bin")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(f).alias("feature"), "bin", "n"))
    return reduce(lambda a, b: a.unionByName(b), counts)


@query(data.ctes(data.PRIVATE_SQL, data.POOL_SQL, f"q AS (SELECT row_id, {_BIN.format(_WORDS)} AS bin FROM pool1)", f"p AS (SELECT {_BIN.format(_WORDS)} AS bin FROM private)") + """, b AS (SELECT bin, p, p / q AS weight, sum(p) OVER () AS covered FROM (SELECT bin, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM p GROUP BY 1) JOIN (SELECT bin, count(*)::DOUBLE / sum(count(*)) OVER () AS q FROM q GROUP BY 1) USING (bin))
SELECT row_id, bin, round(weight, 6) AS weight, round(covered, 6) AS covered FROM q JOIN b USING (bin)""")
def length_weights_pool(spark, sf_dir):
    """Importance weights of pool texts to the private lengths."""
    bin_ = length_bin(word_count(F.coalesce("text", F.lit("")))).alias("bin")
    return _rounded(length_weights(data.pool(spark, sf_dir, "text").select("row_id", bin_), data.private(spark, sf_dir, "text").select(bin_), "bin"))


@query(f"SELECT count(*) AS tokens, count(DISTINCT w) AS types FROM (SELECT unnest({_WHITE.replace('(t,', '(lower(text),')}) AS w FROM documents)")
def ws_token_dedupe(spark, sf_dir):
    """White-space tokens of all documents and how many are different."""
    from ..functions.labels import words

    w = data.table(spark, sf_dir, "documents").select(F.explode(words(F.lower("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return w.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("types"))


@query("SELECT source, coalesce(round(avg((n_chars > 1000)::INTEGER), 6), 0) AS share_over, count(*) AS texts FROM documents GROUP BY source")
def share_over_limit(spark, sf_dir):
    """Share of texts above 1,000 characters by source."""
    over = F.avg((F.col("n_chars") > 1000).cast("double"))
    return data.table(spark, sf_dir, "documents").groupBy("source").agg(F.coalesce(F.round(over, 6), F.lit(0.0)).alias("share_over"), F.count(F.lit(1)).alias("texts"))
