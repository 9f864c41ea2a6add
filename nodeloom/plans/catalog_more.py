"""More queries over whole tables, each beside its SQL: algebra, mutations, sources and sinks, evaluation, query tools."""

from __future__ import annotations

from pyspark.sql import functions as F

from nodeloom.functions import text as X
from nodeloom.functions import vectors as V
from nodeloom.operators import graph as G
from nodeloom.operators import relational as R
from nodeloom.plans.catalog import _COS, _DOWN, _E, _G, _NORM, _OE, DIM, docs, embeddings, own_edges, query, senses
from nodeloom.runtime import Scratch, table

# -- vector algebra ----------------------------------------------------------------------------------------------------


@query(f"""WITH {_E}, t AS (SELECT a.id, a.v AS v1, b.v AS v2, c.v AS v3, 0.5 + a.label / 20 AS w1, 0.5 + b.label / 20 AS w2, 0.5 + c.label / 20 AS w3, 1 + a.label AS level FROM e a JOIN e b ON b.id = a.id + 1 JOIN e c ON c.id = a.id + 2),
x AS (SELECT *, list_transform(list_zip(v1, v2, v3), lambda z: w1 * z[1] + w2 * z[2] + w3 * z[3]) AS tv, list_transform(list_zip(v1, v2), lambda z: z[1] + z[2]) AS nv, w3 * w3 / sqrt(w1 ** 4 + w2 ** 4 + w3 ** 4) AS raw FROM t)
SELECT id, round(({_NORM.format('tv')})[1], 6) AS triad_x1, round(({_NORM.format('nv')})[64], 6) AS neutral_x64, round(raw, 6) AS strength, round(raw * (1 + 0.5 * (14 - level) / 13.0), 6) AS weight,
round(1 + 0.5 * (14 - level) / 13.0, 6) AS factor, CAST(round(0.9 - 0.01 * level, 2) AS DOUBLE) AS least, round({_COS.format('v1', 'v3')}, 6) AS cosine FROM x""")
def vector_algebra(spark, d):
    e = embeddings(spark, d).withColumn("w", F.lit(0.5) + F.col("label") / 20)
    t = e.select("id", F.col("vec").alias("v1"), F.col("w").alias("w1"), (F.col("label") + 1).alias("level"))
    t = t.join(e.select((F.col("id") - 1).alias("id"), F.col("vec").alias("v2"), F.col("w").alias("w2")), "id").join(e.select((F.col("id") - 2).alias("id"), F.col("vec").alias("v3"), F.col("w").alias("w3")), "id")
    v, w, level = [F.col(x) for x in ("v1", "v2", "v3")], [F.col(x) for x in ("w1", "w2", "w3")], F.col("level")
    return t.select("id", F.round(V.triad_vector(*v, *w)[0], 6).alias("triad_x1"), F.round(V.neutral_edge_vector(v[0], v[1])[63], 6).alias("neutral_x64"), F.round(V.raw_weight(*w), 6).alias("strength"),
                    F.round(V.accumulated_weight(*w, level), 6).alias("weight"), F.round(V.level_factor(level), 6).alias("factor"), V.threshold_floor(level).alias("least"), F.round(V.cosine(v[0], v[2]), 6).alias("cosine"))


@query("""SELECT row_id, coalesce(CASE WHEN list_max(dis1) > 0 THEN CAST(list_position(dis1, list_max(dis1)) - 1 AS INTEGER) END, CASE WHEN (row_id % 100) / 100.0 >= 0.72 THEN sense_idx END) AS sense FROM sense_relations""")
def sense_choice(spark, d):
    return table(spark, d, "sense_relations").select("row_id", X.resolve_sense(F.col("dis1"), F.col("sense_idx"), (F.col("row_id") % 100) / 100.0).alias("sense"))


@query("SELECT row_id, CAST(greatest(1, coalesce(len(sense_ids), 0)) AS INTEGER) AS surface, coalesce(array_to_string(forms[1:10], ', '), '') AS first_forms, word || ' (' || pos || ')' AS label FROM parsed_words")
def word_surfaces(spark, d):
    w = table(spark, d, "parsed_words")
    return w.select("row_id", X.surface(F.col("sense_ids")).alias("surface"), F.coalesce(X.first_words(F.col("forms")), F.lit("")).alias("first_forms"), X.node_label(F.col("word"), F.col("pos")).alias("label"))


# -- mutations ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {_G}, m AS (SELECT id AS parent, unnest([cm1_id, cm2_id, bridge_id]) AS id FROM g WHERE doc_type <> 'node'), p AS (SELECT id, max(parent) AS parent FROM m WHERE id IS NOT NULL GROUP BY id)
SELECT g.id, coalesce(p.parent, g.parent_edge_id) AS parent_edge_id FROM g LEFT JOIN p ON p.id = g.id""")
def set_parents(spark, d):
    g = docs(spark, d)
    m = g.filter("doc_type <> 'node'").select(F.col("id").alias("parent"), F.explode(F.array("cm1_id", "cm2_id", "bridge_id")).alias("member_id"))
    return R.set_parent(g, m).select("id", "parent_edge_id")


@query(f"""WITH {_G}, a AS (SELECT id, doc_type, level, CASE WHEN level % 2 = 0 THEN 'old ' || id END AS old FROM g)
SELECT id, CASE WHEN doc_type <> 'node' AND level <= 13 THEN coalesce(old, 'new ' || id) ELSE old END AS guarded, CASE WHEN doc_type <> 'node' AND level <= 13 THEN 'new ' || id ELSE old END AS plain FROM a""")
def label_writes(spark, d):
    g = docs(spark, d).withColumn("semantic_label", F.when(F.col("level") % 2 == 0, F.concat(F.lit("old "), "id")))
    g = g.withColumn("label_vector", F.lit(None).cast("array<double>")).withColumn("label_model", F.lit(None).cast("string")).withColumn("label_updated_at", F.lit(None).cast("timestamp"))
    new = g.select("id", F.concat(F.lit("new "), "id").alias("semantic_label"), F.array(F.lit(1.0)).alias("label_vector"), F.lit("m").alias("label_model"))
    bad = new.select("id", F.lit("refused").alias("semantic_label"), F.array(F.lit(1.0), F.lit(2.0)).alias("label_vector"), "label_model")
    new = new.unionByName(bad)
    a = R.write_labels(g, new, 1).select("id", F.col("semantic_label").alias("guarded"))
    return a.join(R.write_labels(g, new, 1, guarded=False).select("id", F.col("semantic_label").alias("plain")), "id")


@query("""WITH w AS (SELECT word, pos, lang_code AS lang FROM parsed_words WHERE word IS NOT NULL AND pos IS NOT NULL QUALIFY row_number() OVER (PARTITION BY word, pos ORDER BY row_id DESC) = 1)
SELECT word, pos, lang FROM w WHERE NOT EXISTS (SELECT 1 FROM core_words c WHERE c.word = w.word AND c.pos = w.pos) UNION ALL SELECT word, pos, 'core' FROM core_words""")
def bulk_upsert(spark, d):
    w = R.last_wins(table(spark, d, "parsed_words").filter("word IS NOT NULL AND pos IS NOT NULL").select("word", "pos", "row_id", F.col("lang_code").alias("lang")), ["word", "pos"], "row_id").drop("row_id")
    return R.upsert(w, table(spark, d, "core_words").select("word", "pos", F.lit("core").alias("lang")), ["word", "pos"])


@query("""WITH t AS (SELECT word, pos, max_by(sense_ids, row_id) AS ids FROM parsed_words WHERE word <> '' AND pos <> '' GROUP BY word, pos),
u AS (SELECT word, pos, list_sort(list(DISTINCT sense_id)) AS ids, count(*) AS n, min(gloss) AS gloss FROM parsed_senses WHERE word <> '' AND pos <> '' AND sense_id IS NOT NULL GROUP BY word, pos)
SELECT coalesce(t.word, u.word) AS word, coalesce(t.pos, u.pos) AS pos, array_to_string(list_sort(list_distinct(list_concat(coalesce(t.ids, []), coalesce(u.ids, [])))), ',') AS ids, coalesce(len(t.ids), 0) + coalesce(u.n, 0) AS surface, CASE WHEN t.word IS NULL THEN u.gloss END AS made_for
FROM t FULL JOIN u ON u.word = t.word AND u.pos = t.pos""")
def merged_updates(spark, d):
    t = R.last_wins(table(spark, d, "parsed_words").filter("word <> '' AND pos <> ''").select("word", "pos", "row_id", F.col("sense_ids").alias("ids")), ["word", "pos"], "row_id").drop("row_id")
    t = t.withColumn("surface", F.size(F.coalesce("ids", F.array().cast("array<string>"))).cast("bigint")).withColumn("made_for", F.lit(None).cast("string"))
    u = table(spark, d, "parsed_senses").filter("word <> '' AND pos <> '' AND sense_id IS NOT NULL").select("word", "pos", F.array("sense_id").alias("id"), F.lit(1).alias("one"), F.concat(F.lit(""), "gloss").alias("gloss"))
    u = u.join(u.groupBy("word", "pos").agg(F.min("gloss").alias("g")), ["word", "pos"]).select("word", "pos", "id", "one", "g")
    m = R.merge_updates(t, u, ["word", "pos"], add={"ids": "id"}, inc={"surface": "one"}, first={"made_for": "g"})
    return m.select("word", "pos", F.array_join(F.array_sort("ids"), ",").alias("ids"), "surface", "made_for")


# -- sources and sinks -------------------------------------------------------------------------------------------------


@query("SELECT event_id, event_type FROM events WHERE event_id > 5000")
def resumed_scan(spark, d):
    from nodeloom.sources.dictionary import resume_after

    return resume_after(table(spark, d, "events").select("event_id", "event_type"), "event_id", 5000)


@query("""WITH t AS (SELECT doc_id, source, headword, text FROM documents WHERE trim(headword, ' ') <> '' AND trim(text, ' ') <> ''),
n AS (SELECT doc_id, CASE WHEN trim(source) <> '' AND lower(trim(source)) NOT IN ('(no doi)', 'no doi', 'n/a', 'none') THEN trim(source) END AS doi, headword, text, trim(regexp_replace(headword, '\\s+', ' ', 'g')) AS norm_term FROM t),
s AS (SELECT *, CASE WHEN doi IS NOT NULL THEN 'batch:' || doi || ':t' || CAST(doc_id AS VARCHAR) ELSE 'batch:nodoi:t' || CAST(doc_id AS VARCHAR) || ':' || substr(sha1(text), 1, 10) END AS sense_id FROM n)
SELECT norm_term, arg_min(sense_id, doc_id) AS sense_id, coalesce(array_to_string(list_sort(list(DISTINCT doi) FILTER (doi IS NOT NULL)), ','), '') AS dois FROM s GROUP BY norm_term, text""")
def batch_terms(spark, d):
    """Documents as term records: written as JSON lines, read as a batch, completed and exact copies merged."""
    from nodeloom.sources.sinks import write_json
    from nodeloom.sources.terms import dedupe, read_terms

    t = table(spark, d, "documents").select("doc_id", "source", F.struct(F.concat(F.lit("t"), "doc_id").alias("id"), F.col("headword").alias("term"), F.col("text").alias("gloss")).alias("t"))
    wrapped = F.when(F.col("doc_id") % 2 == 0, F.struct(F.lit("10.1/inner").alias("doi"), F.array("t").alias("terms")))
    path = Scratch(spark, "terms").root
    write_json(t.select(F.col("source").alias("doi"), F.when(F.col("doc_id") % 2 == 1, F.array("t")).alias("terms"), wrapped.alias("extracted"), F.lit(0.1).alias("cost_usd")), path)
    r = read_terms(spark, path).withColumn("ord", F.regexp_extract("term_id", "[0-9]+", 0).cast("bigint"))
    return dedupe(r).select("norm_term", "sense_id", F.array_join("dois", ",").alias("dois"))


@query("""SELECT row_id AS ord, coalesce(CASE WHEN sense_id <> '' THEN sense_id END, word || '-' || pos || '-1') AS sense_id, 1 AS sense_idx, gloss, array_to_string(coalesce(list_filter(examples, lambda x: x <> ''), []), '|') AS examples,
trim(concat_ws(' ', gloss, CASE WHEN len(list_filter(examples, lambda x: x <> '')) > 0 THEN array_to_string(list_filter(examples, lambda x: x <> '')[1:2], ' ') END)) AS embed_text, coalesce(array_to_string(topics, ','), '') AS topics
FROM parsed_senses WHERE word <> '' AND pos <> '' AND gloss <> ''""")
def dictionary_rebuilt(spark, d):
    """Senses as dictionary lines, with an empty sense ahead of each, through the dictionary reader."""
    from nodeloom.sources.dictionary import parse_lines

    s = table(spark, d, "parsed_senses")
    one = F.struct(F.col("sense_id").alias("id"), F.array("gloss").alias("glosses"), F.transform("examples", lambda x: F.struct(x.alias("text"))).alias("examples"), "topics")
    none = F.struct(F.lit("x").alias("id"), F.array(F.lit("")).alias("glosses"), F.array().cast("array<struct<text:string>>").alias("examples"), F.array().cast("array<string>").alias("topics"))
    lines = s.select(F.col("row_id").alias("ord"), F.to_json(F.struct("word", "pos", F.lit("en").alias("lang_code"), F.array(none, one).alias("senses"))).alias("value"))
    out = parse_lines(lines)[1]
    return out.select("ord", "sense_id", "sense_idx", "gloss", F.array_join("examples", "|").alias("examples"), "embed_text", F.array_join("topics", ",").alias("topics"))


@query("""SELECT row_id AS ord, word, pos, CASE WHEN ipa <> '' THEN ipa END AS ipa, array_to_string(coalesce(list_filter(forms, lambda x: x <> ''), []), ',') AS forms, CASE WHEN word <> 'x' THEN 'antonyms:' || word || ':3 0|synonyms:' || word || 'x:' END AS relations
FROM parsed_words WHERE word <> '' AND pos <> '' AND coalesce(lang_code, 'en') = 'en'""")
def dictionary_entries(spark, d):
    """Words as dictionary lines with tagged and plain sounds and relations, through the dictionary reader."""
    from nodeloom.sources.dictionary import parse_lines

    w = table(spark, d, "parsed_words")

    def sound(text, *tags):
        return F.struct(text.alias("ipa"), F.array(*[F.lit(t) for t in tags]).cast("array<string>").alias("tags"))

    rel = [F.struct(F.col("word").alias("word"), F.lit("3 junk").alias("_dis1")), F.struct(F.lit("").alias("word"), F.lit("9").alias("_dis1"))]
    rec = F.struct("word", "pos", "lang_code", F.array(sound(F.when(F.col("ipa") != "", F.lit("tagged")), "us"), sound(F.col("ipa"))).alias("sounds"), F.transform("forms", lambda x: F.struct(x.alias("form"))).alias("forms"),
                   F.array(F.struct(F.array(F.lit("g")).alias("glosses"))).alias("senses"), F.array(F.struct(F.concat("word", F.lit("x")).alias("word"), F.lit(None).cast("string").alias("_dis1"))).alias("synonyms"), F.array(*rel).alias("antonyms"))
    out = parse_lines(w.select(F.col("row_id").alias("ord"), F.to_json(rec).alias("value")))[0]
    shown = F.transform("relations", lambda r: F.concat(r["kind"], F.lit(":"), r["word"], F.lit(":"), F.array_join(r["dis1"].cast("array<string>"), " ")))
    return out.select("ord", "word", "pos", "ipa", F.array_join("forms", ",").alias("forms"), F.when(F.col("word") != "x", F.array_join(shown, "|")).alias("relations"))


@query("SELECT CAST(row_id AS VARCHAR) AS id, trim(gloss) AS semantic_label FROM parsed_senses WHERE row_id % 5 <> 0 AND length(trim(gloss)) BETWEEN 3 AND 200")
def label_answers(spark, d):
    """Glosses as answers of a labelling job, a fifth of them failed ones, written as JSON lines and read back."""
    from nodeloom.plans.labels import answers
    from nodeloom.sources.sinks import write_json

    s = table(spark, d, "parsed_senses")
    text = F.to_json(F.struct(F.col("gloss").alias("semantic_label")))
    code = F.when(F.col("row_id") % 5 == 0, 3).otherwise(0)
    path = Scratch(spark, "answers").root
    write_json(s.select(F.col("row_id").cast("string").alias("key"), F.struct(code.alias("code"), F.lit("").alias("message")).alias("status"),
                        F.struct(F.array(F.struct(F.struct(F.array(F.struct(text.alias("text"))).alias("parts")).alias("content"))).alias("candidates")).alias("response")), path)
    return answers(spark, path)


@query("SELECT DISTINCT sense_id AS id FROM parsed_senses WHERE sense_id IS NOT NULL")
def touched_scope(spark, d):
    """Touched ids, written by the ingest's sink and read back as the scope of a recomputation."""
    from nodeloom.sources.dictionary import word_scope
    from nodeloom.sources.sinks import write_touched

    path = Scratch(spark, "touched").root
    write_touched(table(spark, d, "parsed_senses").select(F.col("sense_id").alias("id")), path)
    return word_scope(spark, path)


@query("SELECT DISTINCT substr(sha256(word || '|' || pos), 1, 24) AS id FROM core_words")
def inserted_ids(spark, d):
    from nodeloom.sources.sinks import insert

    return insert(table(spark, d, "core_words"), Scratch(spark, "inserted").root, "word", "pos").distinct()


# -- evaluation --------------------------------------------------------------------------------------------------------

_WE = """wd AS (SELECT id, word FROM g WHERE node_type = 'word' AND word IS NOT NULL), x AS (SELECT id AS eid, cm1_id AS c, cm2_id AS o FROM g WHERE doc_type <> 'node' AND level = 14 UNION SELECT id, cm2_id, cm1_id FROM g WHERE doc_type <> 'node' AND level = 14),
we AS (SELECT DISTINCT wd.word, x.eid, p.word AS partner FROM x JOIN wd ON wd.id = x.c LEFT JOIN wd p ON p.id = x.o)"""
_SYN = "pr AS (SELECT DISTINCT least(from_word, word) AS a, greatest(from_word, word) AS b FROM sense_relations WHERE kind = 'synonyms' AND from_word <> word)"


def _synonyms(spark, d):
    return R.unordered_pairs(table(spark, d, "sense_relations").filter("kind = 'synonyms'"), "from_word", "word")


@query(f"""WITH RECURSIVE {_G}, {_SYN}, {_WE}, u AS (SELECT a.id, b.id AS p FROM g a JOIN g b ON b.id = a.parent_edge_id),
up AS (SELECT word, id FROM wd UNION SELECT up.word, u.p FROM up JOIN u ON u.id = up.id), ch AS (SELECT DISTINCT up.word, up.id, g.level FROM up JOIN g ON g.id = up.id WHERE g.doc_type <> 'node' AND g.level <= 13),
n AS (SELECT DISTINCT word, partner FROM we WHERE partner IS NOT NULL), eo AS (SELECT a, b, count(DISTINCT x.eid) AS n FROM pr JOIN we x ON x.word = a JOIN we y ON y.word = b AND y.eid = x.eid GROUP BY a, b),
wo AS (SELECT a, b, count(*) AS n FROM pr JOIN n x ON x.word = a JOIN n y ON y.word = b AND y.partner = x.partner GROUP BY a, b), br AS (SELECT a, b, min(x.level) AS l FROM pr JOIN ch x ON x.word = a JOIN ch y ON y.word = b AND y.id = x.id GROUP BY a, b),
sz AS (SELECT word, count(*) AS n FROM n GROUP BY word), f AS (SELECT pr.a, pr.b, coalesce(eo.n, 0) AS edge_overlap, coalesce(wo.n, 0) AS word_overlap, coalesce(s.n, 0) + coalesce(t.n, 0) - coalesce(wo.n, 0) AS un,
  CASE WHEN EXISTS (SELECT 1 FROM n WHERE word = pr.a AND partner = pr.b) OR EXISTS (SELECT 1 FROM n WHERE word = pr.b AND partner = pr.a) THEN 1 ELSE 0 END AS direct_hit, br.l AS bridge_level_min
  FROM pr LEFT JOIN eo ON eo.a = pr.a AND eo.b = pr.b LEFT JOIN wo ON wo.a = pr.a AND wo.b = pr.b LEFT JOIN br ON br.a = pr.a AND br.b = pr.b LEFT JOIN sz s ON s.word = pr.a LEFT JOIN sz t ON t.word = pr.b)
SELECT a, b, edge_overlap, word_overlap, CASE WHEN un > 0 THEN round(word_overlap / un, 6) ELSE 0 END AS word_jaccard, direct_hit, bridge_level_min FROM f""")
def pair_metrics(spark, d):
    g = docs(spark, d)
    w = g.filter("node_type = 'word' AND word IS NOT NULL").select("id", "word")
    e = G.edges_of_words(g, w.select(F.col("id").alias("word_id"))).join(w.select(F.col("id").alias("word_id"), "word"), "word_id")
    e = e.join(w.select(F.col("id").alias("partner_id"), F.col("word").alias("partner")), "partner_id", "left")
    up = G.ancestors(spark, g, w.select("id"), None)
    t = g.filter("doc_type <> 'node' AND level <= 13").select("id", "level")
    ch = up.join(t, "id").join(w.select(F.col("id").alias("start"), "word"), "start").select("word", "id", "level")
    return R.pair_metrics(_synonyms(spark, d), e.select("word", "edge_id", "partner"), ch).withColumn("word_jaccard", F.round("word_jaccard", 6))


@query(f"""{_DOWN}, {_SYN}, p AS (SELECT a || '|' || b AS pair, a, b FROM pr), wd AS (SELECT id, word FROM g WHERE node_type = 'word'),
eh AS (SELECT p.pair, p.b, e.id FROM p JOIN wd ON wd.word = p.a JOIN g e ON e.doc_type <> 'node' AND e.level = 14 AND (e.cm1_id = wd.id OR e.cm2_id = wd.id)),
gh AS (SELECT DISTINCT eh.pair FROM eh JOIN t ON t.start = eh.id JOIN g l ON l.id = t.id AND l.doc_type = 'node' AND l.word = eh.b),
nh AS (SELECT DISTINCT p.pair FROM p JOIN g n ON n.doc_type = 'node' AND n.word = p.a AND n.word = p.b)
SELECT 'graph' AS method, round((SELECT count(*) FROM gh) / (SELECT count(*) FROM p), 6) AS recall, (SELECT count(*) FROM p) AS n UNION ALL SELECT 'flat', round((SELECT count(*) FROM nh) / (SELECT count(*) FROM p), 6), (SELECT count(*) FROM p)""")
def graph_recall(spark, d):
    """Recall of synonym pairs: word edges of one word that have the other among their leaves, against nodes of the word."""
    from nodeloom.plans.evaluate import graph_recall as recall

    g = docs(spark, d)
    p = _synonyms(spark, d).select(F.concat_ws("|", "a", "b").alias("pair"), "a", F.col("b").alias("word_b"))
    w = g.filter("node_type = 'word'").select(F.col("id").alias("word_id"), F.col("word").alias("a"))
    e = G.edges_of_words(g, w.select("word_id")).join(w, "word_id").select("a", F.col("edge_id").alias("id"))
    n = g.filter("doc_type = 'node'").select("id", F.col("word").alias("a"))
    return recall(spark, g, p.join(e, "a").select("pair", "id"), p.join(n, "a").select("pair", "id"), p.select("pair", "word_b")).withColumn("recall", F.round("recall", 6))


@query(f"""{_DOWN}, {_OE.removeprefix(_G + ', ')}, {_SYN}, fs AS (SELECT word, arg_min(v, id) AS v FROM n WHERE word IS NOT NULL GROUP BY word), p AS (SELECT a || '|' || b AS pair, b, fs.v FROM pr JOIN fs ON fs.word = pr.a),
eh AS (SELECT p.pair, p.b, ed.id FROM p, ed QUALIFY row_number() OVER (PARTITION BY p.pair ORDER BY round({_COS.format('p.v', 'ed.v')}, 12) DESC, ed.id) <= 10),
nh AS (SELECT p.pair, p.b, n.id, n.word FROM p, n QUALIFY row_number() OVER (PARTITION BY p.pair ORDER BY round({_COS.format('p.v', 'n.v')}, 12) DESC, n.id) <= 10),
gh AS (SELECT DISTINCT eh.pair FROM eh JOIN t ON t.start = eh.id JOIN g l ON l.id = t.id AND l.doc_type = 'node' AND l.word = eh.b)
SELECT 'graph' AS method, round((SELECT count(*) FROM gh) / (SELECT count(*) FROM p), 6) AS recall, (SELECT count(*) FROM p) AS n UNION ALL SELECT 'flat', round((SELECT count(DISTINCT pair) FROM nh WHERE word = b) / (SELECT count(*) FROM p), 6), (SELECT count(*) FROM p)""")
def search_recall(spark, d):
    """Recall at ten of leaf edges against senses, by the vector of one word of each synonym pair."""
    from nodeloom.plans.evaluate import search_recall as recall

    g, n, e = own_edges(spark, d)
    first = n.filter("word IS NOT NULL").groupBy(F.col("word").alias("a")).agg(F.min_by("vec", "id").alias("vec"))
    p = _synonyms(spark, d).join(first, "a").select(F.concat_ws("|", "a", "b").alias("pair"), F.col("b").alias("word_b"), V.doubles(F.col("vec")).alias("vec"))
    v = n.select("id", V.doubles(F.col("vec")).alias("vec")).unionByName(e)
    return recall(spark, g, v, p.select("pair", "word_b"), p.select("pair", "vec"), DIM, 10).withColumn("recall", F.round("recall", 6))


@query(f"WITH {_G}, m AS (SELECT DISTINCT unnest([cm1_id, cm2_id, bridge_id, parent_edge_id]) AS id FROM g) SELECT id FROM m WHERE id <> '' AND id NOT IN (SELECT id FROM g)")
def missing_members(spark, d):
    g = docs(spark, d)
    m = g.select(F.explode(F.array("cm1_id", "cm2_id", "bridge_id", "parent_edge_id")).alias("id")).filter("id <> ''").distinct()
    return m.join(g.select("id"), "id", "left_anti")


# -- query tools -------------------------------------------------------------------------------------------------------


def _api(spark, d):
    from nodeloom.options import Options
    from nodeloom.plans.api import GraphAPI

    g = docs(spark, d)
    s = table(spark, d, "parsed_senses").filter("sense_id IS NOT NULL").groupBy("sense_id").agg(F.min(F.struct("row_id", "sense_idx", "gloss", "tags", "topics")).alias("s"))
    g = g.join(s.select("sense_id", "s.sense_idx", "s.gloss", "s.tags", "s.topics"), "sense_id", "left")
    v = g.filter("node_type = 'sense'").select("id", "sense_id").join(senses(spark, d).select(F.col("id").alias("sense_id"), "vec"), "sense_id").select("id", "vec")
    return GraphAPI(spark, g, v, None, Options(dim=DIM))


def _word(spark, d) -> str:
    """The first word, in order, that a word edge begins with."""
    g = docs(spark, d)
    e = g.filter("doc_type <> 'node' AND level = 14").select(F.col("cm1_id").alias("id"))
    return g.filter("node_type = 'word'").join(e, "id", "left_semi").agg(F.min("word").alias("w")).first()["w"]


_WORD = "(SELECT min(w.word) FROM g w JOIN g e ON e.cm1_id = w.id WHERE w.node_type = 'word' AND e.doc_type <> 'node' AND e.level = 14)"


@query(f"""WITH {_G}, w AS (SELECT id, word, pos, parent_edge_id IS NOT NULL AS has_parent FROM g WHERE node_type = 'word' AND word = {_WORD}),
e AS (SELECT unnest([cm1_id, cm2_id]) AS id FROM g WHERE doc_type <> 'node' AND level = 14) SELECT w.*, (SELECT count(*) FROM e WHERE e.id = w.id) AS degree FROM w""")
def tool_find_word(spark, d):
    return _api(spark, d).find_word(_word(spark, d))


@query(f"""WITH {_G}, s AS (SELECT * FROM parsed_senses WHERE sense_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sense_id ORDER BY row_id) = 1)
SELECT g.id, s.sense_idx, g.pos, s.gloss, coalesce(array_to_string(s.tags, ','), '') AS tags, coalesce(array_to_string(s.topics, ','), '') AS topics, g.parent_edge_id IS NOT NULL AS paired FROM g LEFT JOIN s ON s.sense_id = g.sense_id WHERE g.node_type = 'sense' AND g.word = (SELECT word FROM g WHERE node_type = 'sense' AND word IS NOT NULL GROUP BY word ORDER BY count(*) DESC, word LIMIT 1)""")
def tool_word_senses(spark, d):
    w = docs(spark, d).filter("node_type = 'sense' AND word IS NOT NULL").groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "word").first()["word"]
    r = _api(spark, d).word_senses(w)
    return r.select("id", "sense_idx", "pos", "gloss", F.coalesce(F.array_join("tags", ","), F.lit("")).alias("tags"), F.coalesce(F.array_join("topics", ","), F.lit("")).alias("topics"), "paired")


@query(f"""WITH {_G}, w AS (SELECT id FROM g WHERE node_type = 'word' AND word = {_WORD}), e AS (SELECT id, cm1_id AS c, cm2_id AS o, edge_type, q FROM g WHERE doc_type <> 'node' AND level = 14 UNION SELECT id, cm2_id, cm1_id, edge_type, q FROM g WHERE doc_type <> 'node' AND level = 14)
SELECT w.id AS word_id, e.id AS edge_id, e.edge_type, e.q, e.o AS partner_id, CASE WHEN p.doc_type = 'node' THEN p.label ELSE p.doc_type END AS partner_label FROM w JOIN e ON e.c = w.id LEFT JOIN g p ON p.id = e.o""")
def tool_word_edges(spark, d):
    return _api(spark, d).word_edges(_word(spark, d))


def _top(spark, d):
    """The triad of lowest level, of these the smallest id."""
    return docs(spark, d).filter("doc_type <> 'node' AND level <= 13").orderBy("level", "id").first()["id"]


_FIRST = "f AS (SELECT id FROM g WHERE doc_type <> 'node' AND level <= 13 ORDER BY level, id LIMIT 1)"


@query(f"{_DOWN}, {_FIRST} SELECT DISTINCT t.id, g.word, g.pos, g.node_type FROM t JOIN f ON f.id = t.start JOIN g ON g.id = t.id WHERE g.doc_type = 'node'")
def tool_leaf_nodes(spark, d):
    return _api(spark, d).leaf_nodes(_top(spark, d)).select("id", "word", "pos", "node_type")


@query(f"{_DOWN}, {_FIRST} SELECT t.start, array_to_string(list_sort(list(DISTINCT g.word)), ',') AS words FROM t JOIN f ON f.id = t.start JOIN g ON g.id = t.id WHERE g.doc_type = 'node' AND g.word IS NOT NULL GROUP BY t.start")
def tool_edge_info(spark, d):
    return _api(spark, d).edge_info(_top(spark, d))["words"].select("start", F.array_join("words", ",").alias("words"))


@query(f"""WITH RECURSIVE {_G}, s AS (SELECT id FROM g WHERE node_type = 'sense' ORDER BY id LIMIT 1), u AS (SELECT a.id, b.id AS p FROM g a JOIN g b ON b.id = a.parent_edge_id),
t AS (SELECT id, 0 AS step, [id] AS path FROM s UNION ALL SELECT u.p, t.step + 1, list_append(t.path, u.p) FROM t JOIN u ON u.id = t.id WHERE t.step < 6 AND NOT list_contains(t.path, u.p))
SELECT t.id, CAST(t.step AS INTEGER) AS step, g.level, g.cm1_id, g.cm2_id FROM t JOIN g ON g.id = t.id WHERE t.step > 0""")
def tool_traverse_up(spark, d):
    first = docs(spark, d).filter("node_type = 'sense'").orderBy("id").first()["id"]
    return _api(spark, d).traverse_up(first).select("id", "step", "level", "cm1_id", "cm2_id")


@query(f"WITH {_G} SELECT id, level FROM g WHERE doc_type <> 'node' AND level = 12 ORDER BY id LIMIT 50 OFFSET 5")
def tool_scan_unlabeled(spark, d):
    return _api(spark, d).scan_unlabeled(12, 50, 5).select("id", "level")


@query(f"WITH {_G} SELECT id, level, parent_edge_id FROM g WHERE doc_type <> 'node' AND level = 13 ORDER BY md5('0|' || id), id LIMIT 20")
def tool_sample_triads(spark, d):
    return _api(spark, d).sample_triads(13, 20)["triads"]


@query(f"""WITH {_G}, w AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM g WHERE node_type = 'sense' AND sense_id IN (SELECT sense_id FROM parsed_senses WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(vector, lambda x: x <> 0)) > 0))
SELECT substr(sha256('15|' || a.id || '|' || b.id), 1, 24) AS id, a.id AS cm1_id, b.id AS cm2_id, 15 AS level, CAST(NULL AS VARCHAR) AS edge_type, 1.0::DOUBLE AS q, 1.0::DOUBLE AS confidence, 'ingested' AS source FROM w a, w b WHERE a.n = 1 AND b.n = 2""")
def tool_create_edge(spark, d):
    a = _api(spark, d)
    two = [r["id"] for r in a.vectors.select("id").orderBy("id").limit(2).collect()]
    new, b = a.create_edge(*two)
    return b.graph.filter(F.col("id") == new).select("id", "cm1_id", "cm2_id", "level", "edge_type", "q", "confidence", "source")


@query(f"""WITH {_G}, s AS (SELECT sense_id, list_transform(vector, lambda x: CAST(x AS DOUBLE)) AS v FROM parsed_senses WHERE sense_id IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(vector, lambda x: x <> 0)) > 0
  QUALIFY row_number() OVER (PARTITION BY sense_id ORDER BY row_id) = 1), n AS (SELECT g.id, s.v FROM g JOIN s ON s.sense_id = g.sense_id WHERE g.node_type = 'sense'), q AS (SELECT v FROM n ORDER BY id LIMIT 1)
SELECT n.id, round({_COS.format('n.v', 'q.v')}, 6) AS score FROM n, q ORDER BY round({_COS.format('n.v', 'q.v')}, 12) DESC, n.id LIMIT 10""")
def tool_semantic_search(spark, d):
    a = _api(spark, d)
    q = a.vectors.orderBy("id").first()["vec"]
    return a.semantic_search([float(x) for x in q], "node", 10).select("id", F.round("score", 6).alias("score"))


@query(f"""WITH {_G} SELECT substr(sha256('sense|hum|noun|a low sound'), 1, 24) AS id, 'hum (noun) [0]' AS label, 'a low sound' AS gloss, 'e1|e2' AS examples, 'low' AS tags, 'music' AS topics, 0 AS sense_idx, count(*) + 1 AS documents FROM g""")
def tool_create_sense(spark, d):
    new, b = _api(spark, d).create_sense("hum", "noun", "a low sound", ["e1", "e2"], ["low"], ["music"])
    n = b.graph.agg(F.count(F.lit(1)).alias("documents"))
    s = b.graph.filter(F.col("id") == new).select("id", "label", "gloss", F.array_join("examples", "|").alias("examples"), F.array_join("tags", ",").alias("tags"), F.array_join("topics", ",").alias("topics"), "sense_idx")
    return s.crossJoin(F.broadcast(n))  # one row each
