"""Queries of the general data-preparation operators: nested records, missing references, hierarchies."""

from __future__ import annotations

from nodeloom.functions.visual_sql import form_sql, items_sql, lines_sql, mapped_sql, value_sql
from nodeloom.operators import hierarchy, nested, references
from nodeloom.runtime import table


def queries() -> dict:
    return {
        "p1_found": lambda spark, d: nested.nested_values(table(spark, d, "kaikki_lines")),
        "p1_glosses": nested.sense_glosses,
        "p4_found": references.missing_words,
        "p4_report": references.orphan_report,
        "p5_found": hierarchy.graph_hierarchy,
        "p5_paths": hierarchy.graph_intervals,
        "p5_full_paths": hierarchy.graph_paths,
        "p5_descendants": hierarchy.graph_descendants,
        "p5_loops": hierarchy.graph_loops,
    }


_UP = """WITH RECURSIVE g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM graph_docs WHERE id IS NOT NULL) WHERE rn = 1),
u AS (SELECT a.id, b.id AS p FROM g a LEFT JOIN g b ON b.id = a.parent_edge_id),
t AS (SELECT id AS start, id, p, [id] AS path FROM u UNION ALL SELECT t.start, u.id, u.p, list_append(t.path, u.id) FROM t JOIN u ON u.id = t.p WHERE NOT list_contains(t.path, t.p)),
e AS (SELECT start, id, p, path, list_position(path, p) AS k FROM t WHERE p IS NULL OR list_contains(path, p)),
f AS (SELECT start AS id, list_reverse(path) AS path FROM e WHERE p IS NULL),
x AS (SELECT unnest(path[:-2]) AS id, id AS descendant FROM f)"""


def _nested_sql() -> str:
    sense, deep = "line_id, i", "(SELECT line_id, i, e AS s FROM sn)"

    def place(tag: str, src: str, test: str, i: str = "i", j: str = "j") -> str:
        return f"SELECT line_id, '{tag}' AS tbl, CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j FROM {src} WHERE {test}"

    text = "CASE json_type(e) WHEN 'OBJECT' THEN json_extract(e, '$.text') WHEN 'ARRAY' THEN NULL ELSE e END"
    ipa = "CASE json_type(e) WHEN 'OBJECT' THEN json_extract(e, '$.ipa') WHEN 'ARRAY' THEN NULL ELSE e END"
    return " UNION ALL ".join([
        f"WITH {lines_sql()}, sn AS (SELECT * FROM {items_sql('rec', 'j', '$.senses', 'i', 'line_id')} WHERE json_type(e) = 'OBJECT') " + place("gloss", items_sql(deep, "s", "$.glosses", "j", sense), value_sql("e")),
        place("example", items_sql(deep, "s", "$.examples", "j", sense), value_sql(text)),
        place("sound", items_sql("rec", "j", "$.sounds", "i", "line_id"), value_sql(ipa), j="-1"),
        place("synonym", items_sql("rec", "j", "$.synonyms", "i", "line_id"), "json_type(e) = 'OBJECT' AND " + value_sql("json_extract(e, '$._dis1')"), j="-1"),
    ])


def _orphan_sql(last: str) -> str:
    word = "CASE json_type(e) WHEN 'OBJECT' THEN json_extract(e, '$.word') WHEN 'ARRAY' THEN NULL ELSE e END"
    lines = " UNION ALL ".join(f"SELECT line_id, loaded_at, '{a}' AS field, n, CASE WHEN {value_sql(word)} THEN json_extract_string({word}, '$') END AS w FROM {items_sql('rec', 'j', '$.' + a, 'n', 'line_id, loaded_at')}" for a in ("synonyms", "antonyms"))
    return f"""WITH {lines_sql()}, lr AS ({lines}),
rf AS (SELECT 'sense_relations' AS src_table, row_id, 'word' AS field, 0 AS item_idx, word AS w, seen_at AS tm, NULL AS own FROM sense_relations UNION ALL SELECT 'kaikki_lines', line_id, field, n, w, loaded_at, NULL FROM lr
  UNION ALL SELECT 'parsed_senses', row_id, 'word', 0, word, parsed_at, sense_id FROM parsed_senses),
ws AS (SELECT DISTINCT w FROM (SELECT w FROM rf UNION ALL SELECT word FROM parsed_words UNION ALL SELECT word FROM core_words) WHERE w IS NOT NULL), fm AS MATERIALIZED (SELECT w, {form_sql('w')} AS k, trim({mapped_sql('w')}, ' ') <> '' AS real FROM ws),
av AS (SELECT k, min(s) AS s, bool_or(s IS NULL) AS ever FROM (SELECT word, parsed_at AS s FROM parsed_words WHERE deleted_at IS NULL UNION ALL SELECT word, added_at FROM core_words) h JOIN fm ON fm.w = h.word GROUP BY k),
d0 AS (SELECT rf.* FROM rf JOIN fm ON fm.w = rf.w LEFT JOIN av ON av.k = fm.k WHERE fm.real AND (av.k IS NULL OR (NOT av.ever AND rf.tm < av.s))),
sa AS (SELECT sense_id, min(parsed_at) AS s, bool_or(parsed_at IS NULL) AS ever, count(*) AS n FROM parsed_senses WHERE sense_id IS NOT NULL GROUP BY sense_id),
sr AS (SELECT 'sense_relations' AS src_table, r.row_id, 'sense_id' AS field, 0 AS item_idx, r.sense_id, r.seen_at AS tm FROM sense_relations r WHERE trim(r.sense_id, ' ') <> ''),
d1 AS (SELECT sr.* FROM sr LEFT JOIN sa ON sa.sense_id = sr.sense_id WHERE sa.sense_id IS NULL OR (NOT sa.ever AND sr.tm < sa.s)),
gone AS (SELECT d.own FROM (SELECT own, count(DISTINCT row_id) AS n FROM d0 WHERE own IS NOT NULL GROUP BY own) d JOIN sa ON sa.sense_id = d.own WHERE d.n >= sa.n),
inh AS (SELECT sr.* FROM sr JOIN gone ON gone.own = sr.sense_id WHERE NOT EXISTS (SELECT 1 FROM d1 WHERE d1.row_id = sr.row_id)) {last}"""


def oracle_sql() -> dict[str, str]:
    """SQL of the same results, where it can be said on whole tables."""
    return {
        "p1_found": _nested_sql(),
        "p1_glosses": f"""WITH {lines_sql()}, sn AS (SELECT * FROM {items_sql('rec', 'j', '$.senses', 'i', 'line_id, j')} WHERE json_type(e) = 'OBJECT'),
gl AS (SELECT * FROM {items_sql('(SELECT line_id, j, i, e AS s FROM sn)', 's', '$.glosses', 'n', 'line_id, i, s, j')} WHERE json_type(e) <> 'NULL')
SELECT line_id, i, n AS j, json_extract_string(s, '$.id') AS sense_id, json_extract_string(j, '$.word') AS word, CASE WHEN {value_sql('e')} THEN json_extract_string(e, '$') END AS gloss FROM gl""",
        "p4_found": _orphan_sql("SELECT src_table, row_id, field, CAST(item_idx AS INTEGER) AS item_idx, strftime(tm, '%Y-%m') AS period FROM d0 WHERE src_table <> 'parsed_senses'"),
        "p4_report": _orphan_sql("""SELECT src_table, field, strftime(tm, '%Y-%m') AS period, kind, count(*) AS orphans FROM (SELECT src_table, field, tm, 'direct' AS kind FROM d0 UNION ALL SELECT src_table, field, tm, 'direct' FROM d1
  UNION ALL SELECT src_table, field, tm, 'inherited' FROM inh) GROUP BY ALL"""),
        "p5_found": f"""{_UP},
d AS (SELECT DISTINCT x.a, x.b FROM (SELECT id AS a, unnest([cm1_id, cm2_id]) AS b FROM g) x JOIN g ON g.id = x.b),
r AS (SELECT a, b FROM d UNION SELECT r.a, d.b FROM r JOIN d ON d.a = r.b)
SELECT 'up' AS link, start AS id, CASE WHEN p IS NULL THEN id ELSE list_min(path[k:]) END AS root_id, CAST(CASE WHEN p IS NULL THEN len(path) - 1 WHEN k = 1 THEN -1 ELSE -2 END AS INTEGER) AS depth FROM e
UNION ALL SELECT 'down', x.a, min(y.b), -1 FROM r x JOIN r y ON y.a = x.a JOIN r z ON z.a = y.b AND z.b = x.a WHERE x.a = x.b GROUP BY x.a""",
        "p5_paths": f"""{_UP},
n AS (SELECT f.id, path[1] AS root_id, len(path) - 1 AS depth, path[-2] AS up, coalesce(c.n, 0) AS n FROM f LEFT JOIN (SELECT id, count(*) AS n FROM x GROUP BY id) c ON c.id = f.id),
h AS (SELECT id FROM n WHERE up IS NOT NULL QUALIFY row_number() OVER (PARTITION BY up ORDER BY n DESC, id DESC) = 1),
c AS (SELECT id, id AS chain, CAST(0 AS BIGINT) AS pos, CAST([] AS STRUCT(chain VARCHAR, upto BIGINT)[]) AS segs FROM n WHERE up IS NULL
  UNION ALL SELECT n.id, CASE WHEN h.id IS NULL THEN n.id ELSE c.chain END, CASE WHEN h.id IS NULL THEN 0 ELSE c.pos + 1 END,
  CASE WHEN h.id IS NULL THEN list_append(c.segs, {{'chain': c.chain, 'upto': c.pos}}) ELSE c.segs END FROM c JOIN n ON n.up = c.id LEFT JOIN h ON h.id = n.id)
SELECT n.id, n.root_id, CAST(n.depth AS INTEGER) AS depth, c.chain, c.pos, CAST(to_json(c.segs) AS VARCHAR) AS segments, n.n AS descendants FROM n JOIN c ON c.id = n.id
UNION ALL SELECT start, list_min(path[k:]), CASE WHEN k = 1 THEN -1 ELSE -2 END, NULL, NULL, NULL, NULL FROM e WHERE p IS NOT NULL""",
        "p5_loops": f"""{_UP}, d AS (SELECT DISTINCT x.a, x.b FROM (SELECT id AS a, unnest([cm1_id, cm2_id]) AS b FROM g) x JOIN g ON g.id = x.b), r AS (SELECT a, b FROM d UNION SELECT r.a, d.b FROM r JOIN d ON d.a = r.b)
SELECT x.a AS id, min(y.b) AS root_id FROM r x JOIN r y ON y.a = x.a JOIN r z ON z.a = y.b AND z.b = x.a WHERE x.a = x.b GROUP BY x.a""",
        "p5_full_paths": f"{_UP} SELECT id, array_to_string(path, '/') AS path FROM f",
        "p5_descendants": f"{_UP} SELECT id, descendant FROM x",
    }
