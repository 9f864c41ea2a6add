"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from nodeloom.functions.visual_sql import form_sql
from nodeloom.llm import encode, languages, mixing, similar, unify


def queries() -> dict:
    return {
        "p2_found": unify.disguised_values,
        "p3_found": similar.similar_senses,
        "p6_ids": encode.document_ids,
        "p7_draw": mixing.drawn_documents,
        "p7_shares": mixing.reached_shares,
        "p7_allotment": mixing.character_allotment,
        "p8_found": languages.mislabelled_segments,
    }


def oracle_sql() -> dict[str, str]:
    parts = [("parsed_words", "word", "word"), ("parsed_words", "ipa", "ipa"), ("sense_relations", "word", "word")]
    values = " UNION ALL ".join(f"SELECT '{t}' AS src_table, row_id, '{f}' AS field, '{k}' AS kind, {f} AS value FROM {t}" for t, f, k in parts)
    form = f"CASE kind WHEN 'ipa' THEN {form_sql('value', 'ipa')} ELSE {form_sql('value')} END"
    return {
        "p7_allotment": """WITH RECURSIVE s AS (SELECT t.source, t.target_share / (SELECT sum(target_share) FROM mix_targets) AS t, t.max_repeats AS cap, coalesce(d.n, 0) AS size
  FROM mix_targets t LEFT JOIN (SELECT source, sum(n_chars) AS n FROM documents GROUP BY source) d ON d.source = t.source),
w AS (SELECT 0 AS k, CAST((SELECT sum(size) FROM s) AS DOUBLE) AS rest, (SELECT list({'source': source, 't': CAST(t AS DOUBLE), 'most': CAST(size * cap AS DOUBLE)}) FROM s WHERE t > 0 AND size * cap > 0) AS l
  UNION ALL SELECT k + 1, rest - list_sum(list_transform(list_filter(l, lambda x: rest * x.t / u >= x.most), lambda x: x.most)), list_filter(l, lambda x: rest * x.t / u < x.most)
  FROM (SELECT *, list_sum(list_transform(l, lambda x: x.t)) AS u FROM w) WHERE len(list_filter(l, lambda x: rest * x.t / u >= x.most)) > 0),
e AS (SELECT rest, l, list_sum(list_transform(l, lambda x: x.t)) AS u FROM w ORDER BY k DESC LIMIT 1),
f AS (SELECT s.*, CASE WHEN t <= 0 OR size * cap = 0 THEN 0.0 WHEN list_contains(list_transform(e.l, lambda x: x.source), s.source) THEN e.rest * s.t / e.u ELSE size * cap END AS wanted FROM s, e)
SELECT source, round(CAST(t AS DOUBLE), 6) AS target_share, cap AS max_repeats, CAST(size AS BIGINT) AS size, round(CAST(wanted AS DOUBLE), 3) AS wanted, CASE WHEN size > 0 THEN round(least(CAST(wanted AS DOUBLE) / size, cap), 6) ELSE 0.0 END AS epochs FROM f""",
        "p2_found": f"""WITH v AS ({values}), m AS MATERIALIZED (SELECT kind, value, {form} AS form FROM (SELECT DISTINCT kind, value FROM v WHERE value IS NOT NULL))
SELECT v.src_table, v.row_id, v.field FROM v JOIN m ON m.kind = v.kind AND m.value = v.value WHERE m.value <> m.form""",
    }
