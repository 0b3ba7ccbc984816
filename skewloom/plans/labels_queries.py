"""Queries of the label family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import (
    SPACE, clean_labels, clean_value, encode_labels, group_key, has_text, inherited_labels, labels_from_map, length_bin,
    paired_long, to_long, word_count,
)
from ..operators.agreement import cohen_kappa
from ..sources.caches import annotations_to_do, missing
from ..sources.connectors import label_prompt, parse_labels
from ..sources.tables import add_class_id, class_conflicts, class_map, shards
from . import data
from .catalog import query

_WORDS = f"len(list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}+'), lambda x: x <> ''))"
_BIN = "(round_even({} / 50.0::DOUBLE, 0) * 50)::INTEGER::VARCHAR"


@query(data.ctes(*data.PRIVATE_LONG_SQL) + "SELECT row_id, attr, value FROM plong")
def clean_labels_private(spark, sf_dir):
    """Clean labels of every private record and attribute: exact, prefix, fallback."""
    return data.private_long(spark, sf_dir)


@query(data.ctes(data.VOCAB_SQL, data.long_sql("raw", "pool", "row_id", {"model_organism": "model_organism", "disease_mention": "disease_mention"}), data.cleaned_sql("c", "raw", "row_id")) + "SELECT row_id, attr, value FROM c")
def clean_fallback_null(spark, sf_dir):
    """Nulls and strange values go to the fallback, on every delivered pool row."""
    v = data.vocabulary(spark, sf_dir)
    both = ["model_organism", "disease_mention"]
    return to_long(clean_labels(data.table(spark, sf_dir, "pool").select("row_id", *both), v, both), ["row_id"], both)


@query(f"SELECT doc_id, {_WORDS}::INTEGER AS words, {_BIN.format(_WORDS)} AS bin FROM documents")
def word_count_bins(spark, sf_dir):
    """White-space words of every document and their bin."""
    n = word_count(F.coalesce("text", F.lit("")))
    return data.table(spark, sf_dir, "documents").select("doc_id", n.alias("words"), length_bin(n).alias("bin"))


@query(f"SELECT row_id, {_BIN.format('word_count')} AS as_text, round_even(word_count / 50.0::DOUBLE, 0)::INTEGER AS as_number, floor(word_count / 50.0::DOUBLE)::INTEGER AS floored FROM pool")
def length_bins_three_ways(spark, sf_dir):
    """The three binnings of lengths: half-even text, half-even number, floor."""
    n = F.col("word_count")
    return data.table(spark, sf_dir, "pool").select("row_id", length_bin(n).alias("as_text"), F.bround(n / F.lit(50.0)).cast("int").alias("as_number"), F.floor(n / F.lit(50.0)).cast("int").alias("floored"))


_KAPPA = """SELECT attr, n, round(d::DOUBLE / n, 6) AS agree, round(CASE WHEN e < 1 THEN (d::DOUBLE / n - e) / (1 - e) END, 6) AS kappa FROM
(SELECT attr, sum(c)::BIGINT AS n, sum(c) FILTER (a = b) AS d FROM cells GROUP BY attr) JOIN
(SELECT attr, sum(x * y)::DOUBLE / (max(t)::DOUBLE * max(t)) AS e FROM (SELECT attr, a AS v, sum(c) AS x, sum(sum(c)) OVER (PARTITION BY attr) AS t FROM cells GROUP BY attr, a) JOIN (SELECT attr, b AS v, sum(c) AS y FROM cells GROUP BY attr, b) USING (attr, v) GROUP BY attr) USING (attr)"""


@query(data.ctes(data.POOL_SQL, f"pairs AS (SELECT 'length' AS attr, {_BIN.format('word_count_requested')} AS a, {_BIN.format(_WORDS)} AS b FROM pool1 WHERE word_count_requested IS NOT NULL)",
    "cells AS (SELECT attr, a, b, count(*) AS c FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL)") + _KAPPA)
def requested_vs_measured(spark, sf_dir):
    """Compliance: kappa of the requested and the measured length bin."""
    d = data.pool(spark, sf_dir, "word_count_requested", "text").where("word_count_requested is not null")
    pairs = d.select(F.lit("length").alias("attr"), length_bin(F.col("word_count_requested")).alias("a"), length_bin(word_count(F.coalesce("text", F.lit("")))).alias("b"))
    return _rounded(cohen_kappa(pairs, ["attr"]))


def _rounded(df):
    return df.select(*(F.round(c, 6).alias(c) if kind == "double" else c for c, kind in df.dtypes))


_MAPPED = [data.POOL_SQL, data.VOCAB_SQL, f"any_ AS (SELECT *, coalesce({', '.join('map_' + a for a in data.ATTRIBUTES)}) IS NULL AS none_ FROM pool1)",
    data.long_sql("mraw", "any_", "row_id, none_", {a: "map_" + a for a in data.ATTRIBUTES}), data.cleaned_sql("mclean", "mraw", "row_id, none_"),
    "mlong AS (SELECT row_id, attr, CASE WHEN NOT none_ THEN value END AS value FROM mclean)"]


def _mapped_long(spark, sf_dir):
    maps = ["map_" + a for a in data.ATTRIBUTES]
    d = labels_from_map(data.pool(spark, sf_dir, *maps), data.vocabulary(spark, sf_dir), data.ATTRIBUTES)
    return to_long(d.select("row_id", *(F.col("map_" + a).alias(a) for a in data.ATTRIBUTES)), ["row_id"], data.ATTRIBUTES)


@query(data.ctes(*_MAPPED) + "SELECT row_id, attr, value FROM mlong")
def map_labels_all_null(spark, sf_dir):
    """Annotated labels: null only where nothing was annotated."""
    return _mapped_long(spark, sf_dir)


def _label_pairs(spark, sf_dir):
    """(row_id, attr, a, b): carried and annotated label of every pool row and attribute, both from one row."""
    v, maps = data.vocabulary(spark, sf_dir), ["map_" + a for a in data.ATTRIBUTES]
    d = data.pool(spark, sf_dir, *data.ATTRIBUTES, *maps)
    return paired_long(labels_from_map(clean_labels(d, v, data.ATTRIBUTES), v, data.ATTRIBUTES), ["row_id"], data.ATTRIBUTES)


@query(data.ctes(*_MAPPED, *data.POOL_LONG_SQL[1:], "cells AS (SELECT attr, q.value AS a, m.value AS b, count(*) AS c FROM qlong q JOIN mlong m USING (row_id, attr) WHERE m.value IS NOT NULL GROUP BY ALL)") + _KAPPA)
def cohen_kappa_carried(spark, sf_dir):
    """Kappa of carried and annotated labels by attribute."""
    return _rounded(cohen_kappa(_label_pairs(spark, sf_dir), ["attr"]))


@query(data.ctes(*data.POOL_LONG_SQL[:1], data.VOCAB_SQL, data.long_sql("qraw", "pool1", "row_id", {"research_goal": "research_goal"}), data.cleaned_sql("qlong", "qraw", "row_id")) + "SELECT row_id, value AS research_goal, NULL::VARCHAR AS tissue FROM qlong")
def inherited_missing(spark, sf_dir):
    """Carried labels; an attribute that the table lacks is null."""
    d = inherited_labels(data.pool(spark, sf_dir, "research_goal"), data.vocabulary(spark, sf_dir), ["research_goal", "tissue"])
    return d.select("row_id", "research_goal", "tissue")


@query("WITH o AS (SELECT option_id, list_position(['High', 'Medium', 'Low'], 'High') AS x, attr, option_value FROM schema_options) SELECT option_id, attr, CASE WHEN list_contains(['Cell', 'Other'], option_value) THEN option_value ELSE coalesce(list_filter(['Cell', 'Other'], lambda o: starts_with(o, option_value) OR starts_with(option_value, o))[1], 'none') END AS value FROM o")
def clean_exact_prefix(spark, sf_dir):
    """Exact and prefix matches, in both directions, against a vocabulary of prefixes."""
    return data.table(spark, sf_dir, "schema_options").select("option_id", "attr", clean_value(F.col("option_value"), ["Cell", "Other"], "none").alias("value"))


@query("SELECT primary_research_area, research_goal, count(DISTINCT sample_size) AS ids FROM pool WHERE sample_size IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT sample_size) > 1")
def label_id_conflicts(spark, sf_dir):
    """Pairs of pool labels that occur with several sizes, which a class map would refuse."""
    d = data.table(spark, sf_dir, "pool").select("primary_research_area", "research_goal", "sample_size")
    return class_conflicts(d, ["primary_research_area", "research_goal"], "sample_size")


@query(data.ctes(data.VOCAB_SQL) + "SELECT row_id, " + ", ".join(f"(SELECT CASE WHEN list_position(opts, map_{a}) > 0 THEN list_position(opts, map_{a}) - 1 END FROM vocab WHERE attr = '{a}')::INTEGER AS {a}" for a in data.ATTRIBUTES) + " FROM pool")
def encoded_labels(spark, sf_dir):
    """Annotated labels as places in their vocabularies, null where missing or off the list."""
    d = data.table(spark, sf_dir, "pool").select("row_id", *(F.col("map_" + a).alias(a) for a in data.ATTRIBUTES))
    return encode_labels(d, data.vocabulary(spark, sf_dir), data.ATTRIBUTES)


@query(data.ctes(data.PRIVATE_SQL) + "SELECT row_id, option_id AS class_id FROM private JOIN schema_options o ON o.attr = 'research_goal' AND o.option_value = research_goal")
def label_id_lookup(spark, sf_dir):
    """Class ids by exact value; rows of an unknown value drop out."""
    o = data.table(spark, sf_dir, "schema_options").where("attr = 'research_goal'")
    mapping = class_map(o.select(F.col("option_value").alias("research_goal"), F.col("option_id").alias("class_id")), ["research_goal"], "class_id")
    return add_class_id(data.private(spark, sf_dir, "research_goal"), mapping, ["research_goal"], "class_id").select("row_id", "class_id")


@query("SELECT row_id, coalesce(primary_research_area, 'nan') || '|' || coalesce(sample_size, 'nan') || '|' || coalesce(word_count_requested::VARCHAR, 'nan') AS key FROM pool")
def group_keys_display(spark, sf_dir):
    """Prompt keys as text, null as nan."""
    return data.table(spark, sf_dir, "pool").select("row_id", group_key(["primary_research_area", "sample_size", "word_count_requested"]).alias("key"))


@query(data.ctes(data.POOL_SQL, f"k AS (SELECT {', '.join(data.ATTRIBUTES)}, word_count_requested, count(*) AS n FROM pool1 GROUP BY ALL)") + "SELECT count(*) AS groups, count(*) FILTER (n > 1) AS repeated, max(n) AS largest FROM k")
def group_size_profile(spark, sf_dir):
    """Prompt groups, those of several rows, and the largest."""
    n = data.pool(spark, sf_dir, *data.ATTRIBUTES, "word_count_requested").groupBy(*data.ATTRIBUTES, "word_count_requested").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("groups"), F.sum((F.col("n") > 1).cast("bigint")).alias("repeated"), F.max("n").alias("largest"))


@query(f"SELECT row_id FROM pool WHERE coalesce(regexp_matches(text, '[^{SPACE[1:-1]}]'), false)")
def blank_texts_out(spark, sf_dir):
    """Rows with text that is not blank."""
    return data.table(spark, sf_dir, "pool").where(has_text(F.col("text"))).select("row_id")


@query("SELECT event_id, json_extract_string(CASE WHEN json_valid(p) THEN p END, '$.page') AS page, json_extract_string(CASE WHEN json_valid(p) THEN p END, '$.ref') AS ref FROM (SELECT event_id, trim(regexp_replace('```json ' || coalesce(props, 'no json') || '```', '```(json)?', '', 'g')) AS p FROM events)")
def json_parse_tolerant(spark, sf_dir):
    """Fields of fenced JSON; what is no JSON gives nulls."""
    fenced = F.concat(F.lit("```json "), F.coalesce("props", F.lit("no json")), F.lit("```"))
    return data.table(spark, sf_dir, "events").select("event_id", parse_labels(fenced, ["page", "ref"]).alias("p")).select("event_id", "p.*")


@query("WITH c AS (SELECT DISTINCT row_id FROM train_annotations JOIN annotators USING (annotator) WHERE annotator_kind = 'llm') SELECT DISTINCT row_id FROM biorxiv_train_metadata WHERE text IS NOT NULL AND row_id NOT IN (SELECT row_id FROM c)")
def cache_antijoin(spark, sf_dir):
    """Records still to annotate: those that no language model has labelled."""
    d = data.table(spark, sf_dir, "biorxiv_train_metadata").where("text is not null").select("row_id")
    models = data.table(spark, sf_dir, "annotators").where("annotator_kind = 'llm'").select("annotator")
    return missing(d, data.table(spark, sf_dir, "train_annotations").join(models, "annotator", "left_semi"), ["row_id"])


@query("WITH a AS (SELECT row_id, annotation_id, any_value(coalesce(map_sample_size, '\x00') ORDER BY loaded_at DESC) AS lab FROM train_annotations GROUP BY 1, 2), l AS (SELECT row_id, arg_max(lab, annotation_id) AS lab FROM a GROUP BY row_id) SELECT DISTINCT row_id FROM biorxiv_train_metadata WHERE row_id NOT IN (SELECT row_id FROM l WHERE lab <> '\x00')".replace("\x00", "<none>"))
def annotation_retry(spark, sf_dir):
    """Records whose last annotation is missing or an error, to be asked again."""
    log = data.table(spark, sf_dir, "train_annotations")
    one = log.groupBy("row_id", "annotation_id").agg(F.max_by(F.struct("map_sample_size"), "loaded_at").alias("m"))
    one = one.select("row_id", "annotation_id", F.col("m.map_sample_size").alias("labels"), F.when(F.col("m.map_sample_size").isNull(), "unparsed").alias("error"))
    return annotations_to_do(data.table(spark, sf_dir, "biorxiv_train_metadata").select("row_id").distinct(), one, "row_id", "annotation_id", retry_errors=True)


@query("WITH d AS (SELECT doc_id - 1 AS i FROM documents), t AS (SELECT count(*) AS n FROM d) SELECT i, i % 4 AS shard, row_number() OVER (ORDER BY i % 4, i) - 1 AS merged FROM d")
def shard_merge(spark, sf_dir):
    """Four modulo shards and each row's place after they are merged again."""
    d = data.table(spark, sf_dir, "documents").select((F.col("doc_id") - 1).alias("i"))
    return shards(d, "i", 4)


@query("SELECT row_id, md5('Label the text.\nAnswer with JSON only: {\"goal\": \"<a|b>\"}\n\nText:\n' || text) AS digest FROM pool WHERE text IS NOT NULL")
def prompt_digest(spark, sf_dir):
    """Digest of the prompt of every text."""
    p = label_prompt({"goal": ["a", "b"]}, F.col("text"), "Label the text.")
    return data.table(spark, sf_dir, "pool").where("text is not null").select("row_id", F.md5(p).alias("digest"))
