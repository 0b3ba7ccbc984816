"""SQL of the queries that SQL can express."""

from __future__ import annotations

_ATTRIBUTES = (
    "primary_research_area", "model_organism", "experimental_approach", "dominant_data_type",
    "research_focus_scale", "disease_mention", "sample_size", "research_goal",
)
_SPACE = r"[\s\p{Z}\x{0b}\x{85}\x{1c}-\x{1f}]"


def _plain(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


_KEY = ", ".join(f"{_plain(a)} AS {a}" for a in _ATTRIBUTES)
_P1 = f"""WITH RECURSIVE k AS (SELECT DISTINCT row_id, {_KEY}, word_count_requested FROM pool WHERE row_id IS NOT NULL AND word_count_requested IS NOT NULL AND {' AND '.join(f'{a} IS NOT NULL' for a in _ATTRIBUTES)}),
star AS (SELECT row_id AS a, min(row_id) OVER (PARTITION BY {', '.join(_ATTRIBUTES)}, word_count_requested) AS b FROM k),
one AS (SELECT a, b FROM star WHERE a <> b UNION SELECT row_id, parent_row_id FROM pool WHERE parent_row_id IN (SELECT row_id FROM pool) AND row_id <> parent_row_id),
e AS (SELECT a, b FROM one UNION SELECT b, a FROM one), r(row_id, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.row_id)
SELECT row_id, min(root) AS family_row_id FROM r GROUP BY row_id"""

_LABEL = " UNION ".join(
    f"SELECT shard, row_id, '{a}' AS attr, {x} AS label FROM rows"
    for a, x in (("sample_size", _plain("sample_size")), ("dominant_data_type", _plain("dominant_data_type")), ("word_count", "(round_even(word_count / 50.0::DOUBLE, 0) * 50)::BIGINT::VARCHAR"))
)
_P3 = f"""WITH rows AS (SELECT * FROM pool WHERE regexp_matches(text, '[^{_SPACE[1:-1]}]') AND row_id IS NOT NULL AND shard IS NOT NULL), have AS (SELECT shard, attr, label, count(DISTINCT row_id) AS n FROM ({_LABEL}) GROUP BY ALL)
SELECT t.shard, t.attr, t.category FROM quota_targets t LEFT JOIN have h ON h.shard = t.shard AND h.attr = t.attr AND h.label = {_plain('t.category')} WHERE coalesce(n, 0) < greatest(t.share * t.k, coalesce(t.min_rows, 0))"""

_CELLS = " UNION ALL ".join(f"SELECT row_id, '{a}' AS attr, unnest(regexp_split_to_array(lower({a}), '[;|]')) AS t FROM last" for a in ("model_organism", "disease_mention", "experimental_approach"))
_P4 = f"""WITH last AS (SELECT * FROM biorxiv_train_metadata QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY loaded_at DESC) = 1), n AS (SELECT count(*) AS total FROM last),
c AS (SELECT row_id, attr, trim(regexp_replace(t, '{_SPACE}+', ' ', 'g')) AS term FROM ({_CELLS})), g AS (SELECT attr, term, count(*) AS occurrences, count(DISTINCT row_id) AS records FROM c WHERE term <> '' GROUP BY attr, term)
SELECT attr, term, occurrences, records, round(records::DOUBLE / total, 9) AS share, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.1::DOUBLE * total THEN 'common' END AS mark FROM g, n"""

SQL: dict[str, str] = {
    "p1_found": _P1,
    "p3_found": _P3,
    "p4_terms": _P4,
    "p4_found": f"SELECT attr, term, mark FROM ({_P4}) WHERE mark IS NOT NULL",
}
