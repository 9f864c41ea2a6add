"""Queries of the engine's own operators over whole tables, each beside the SQL that gives the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from nodeloom.functions import text as X
from nodeloom.functions import vectors as V
from nodeloom.operators import graph as G
from nodeloom.operators import matching as M
from nodeloom.operators import provenance as P
from nodeloom.operators import relational as R
from nodeloom.operators import simjoin as S
from nodeloom.options import SEEDS, TIERS
from nodeloom.runtime import Scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_LATER: dict = {}
DIM = 64


def query(sql=None):
    """Register the function under its name, with its SQL (a text, or a function that gives it) where there is one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            _LATER[f.__name__] = sql
        return f

    return put


def oracle_sql() -> dict[str, str]:
    return {k: x if isinstance(x, str) else x() for k, x in _LATER.items()}


def docs(spark: SparkSession, d: str) -> DataFrame:
    return G.latest(table(spark, d, "graph_docs"))


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def senses(spark: SparkSession, d: str) -> DataFrame:
    """One row per sense with a usable vector: its first delivery."""
    s = S.usable(table(spark, d, "parsed_senses").filter("sense_id IS NOT NULL"), "vector", DIM)
    g = s.groupBy("sense_id").agg(F.min(F.struct("row_id", "word", "pos", "vector")).alias("s"))
    return g.select(F.col("sense_id").alias("id"), "s.word", "s.pos", F.col("s.vector").alias("vec"))


_G = "g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM graph_docs WHERE id IS NOT NULL) WHERE rn = 1)"
_E = "e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label FROM embeddings)"
_DOT = "list_dot_product({0}, {1})"
_COS = f"({_DOT} / sqrt({_DOT.format('{0}', '{0}')}) / sqrt({_DOT.format('{1}', '{1}')}))"
_S = """s AS (SELECT sense_id AS id, word, pos, list_transform(vector, lambda x: CAST(x AS DOUBLE)) AS v FROM (
  SELECT *, row_number() OVER (PARTITION BY sense_id ORDER BY row_id) AS rn FROM parsed_senses
  WHERE sense_id IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NOT NULL AND isfinite(x))) = 64
    AND len(list_filter(vector, lambda x: x <> 0)) > 0) WHERE rn = 1)"""

# -- search and similarity joins ---------------------------------------------------------------------------------------


@query(f"WITH {_E} SELECT a.id, round({_COS.format('a.v', 'q.v')}, 6) AS score FROM e a, e q WHERE q.id = 0 ORDER BY score DESC, a.id LIMIT 10")
def vector_topk(spark, d):
    e = embeddings(spark, d)
    q = e.filter("id = 0").select(F.col("vec").alias("q"))
    return S.top_k_by_row(e, q, 10).withColumn("score", F.round("score", 6))


@query(f"WITH {_E} SELECT a.id, round({_COS.format('a.v', 'q.v')}, 6) AS score FROM e a, e q WHERE q.id = 0 AND a.label = 3 ORDER BY score DESC, a.id LIMIT 20")
def vector_topk_filtered(spark, d):
    e = embeddings(spark, d)
    q = e.filter("id = 0").select(F.col("vec").alias("q"))
    return S.top_k_by_row(e.filter("label = 3"), q, 20).withColumn("score", F.round("score", 6))


@query(f"WITH {_E} SELECT a.id AS a, b.id AS b, round({_COS.format('a.v', 'b.v')}, 6) AS score FROM e a JOIN e b ON a.id < b.id WHERE {_COS.format('a.v', 'b.v')} >= 0.3")
def cosine_pairs(spark, d):
    return S.pairs(spark, embeddings(spark, d).select("id", "vec"), DIM, 0.3).withColumn("score", F.round("score", 6))


@query(f"""WITH RECURSIVE {_E},
p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY score DESC, a, b) AS n, a, b, score FROM (
  SELECT a.id AS a, b.id AS b, round({_COS.format('a.v', 'b.v')}, 6) AS score FROM e a JOIN e b ON a.id < b.id) WHERE score >= 0.3),
w AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST(NULL AS DOUBLE) AS score
  UNION ALL SELECT p.n, CASE WHEN list_contains(w.used, p.a) OR list_contains(w.used, p.b) THEN w.used ELSE list_concat(w.used, [p.a, p.b]) END,
    CASE WHEN list_contains(w.used, p.a) OR list_contains(w.used, p.b) THEN NULL ELSE p.a END, p.b, p.score FROM w JOIN p ON p.n = w.n + 1)
SELECT a, b, score FROM w WHERE a IS NOT NULL""")
def greedy_match(spark, d):
    p = S.pairs(spark, embeddings(spark, d).select("id", "vec"), DIM, 0.29).withColumn("score", F.round("score", 6))
    return M.greedy_by_score(spark, p, 0.3).select("a", "b", "score")


def _greedy_rounds(spark, d):
    """``greedy_match`` by rounds of mutually best pairs down to the last one, none left to a task."""
    p = S.pairs(spark, embeddings(spark, d).select("id", "vec"), DIM, 0.29).withColumn("score", F.round("score", 6)).filter("score >= 0.3")
    return M.greedy(spark, p, [-F.col("score")], in_task=0).select("a", "b", "score")


QUERIES["greedy_rounds"], _LATER["greedy_rounds"] = _greedy_rounds, _LATER["greedy_match"]


@query(f"""WITH {_E} SELECT a.label, a.id AS a, b.id AS b, round({_COS.format('a.v', 'b.v')}, 6) AS score, round(greatest({_COS.format('a.v', 'b.v')}, 0.4), 6) AS q
FROM e a JOIN e b ON a.label = b.label AND a.id < b.id WHERE {_COS.format('a.v', 'b.v')} >= 0.2""")
def polysemy_pairs(spark, d):
    p = S.pairs_within(embeddings(spark, d), ["label"], DIM, 0.2)
    return p.select("label", "a", "b", F.round("score", 6).alias("score"), F.round(F.greatest("score", F.lit(0.4)), 6).alias("q"))


@query(f"""WITH {_E}, p AS (SELECT a.id AS a, b.id AS b, a.v AS v1, b.v AS v2, c.v AS vt, {_COS.format('a.v', 'b.v')} AS q
  FROM e a JOIN e b ON a.id < b.id CROSS JOIN (SELECT v FROM e WHERE id = 0) c WHERE {_COS.format('a.v', 'b.v')} >= 0.35),
m AS (SELECT a, b, q, list_transform(list_zip(v1, v2, vt), lambda x: q * x[1] + q * x[2] + (1 - q) * x[3]) AS v FROM p)
SELECT a, b, round(q, 6) AS q, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS x1, round(v[64] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS x64 FROM m""")
def edge_vectors(spark, d):
    e = embeddings(spark, d)
    p = S.pairs(spark, e.select("id", "vec"), DIM, 0.35)
    j = p.join(e.select(F.col("id").alias("a"), F.col("vec").alias("v1")), "a").join(e.select(F.col("id").alias("b"), F.col("vec").alias("v2")), "b")
    j = j.crossJoin(F.broadcast(e.filter("id = 0").select(F.col("vec").alias("vt"))))  # one row
    v = j.select("a", "b", F.round("score", 6).alias("q"), V.edge_vector(F.col("v1"), F.col("v2"), F.col("vt"), F.col("score")).alias("v"))
    return v.select("a", "b", "q", F.round(F.col("v")[0], 6).alias("x1"), F.round(F.col("v")[63], 6).alias("x64"))


@query(f"""WITH {_E} SELECT id, match, score FROM (SELECT a.id, b.id AS match, round({_COS.format('a.v', 'b.v')}, 6) AS score,
  row_number() OVER (PARTITION BY a.id ORDER BY round({_COS.format('a.v', 'b.v')}, 12) DESC, b.id) AS r FROM e a, e b WHERE a.label < 5 AND b.label >= 5) WHERE r = 1""")
def orphan_nearest(spark, d):
    e = embeddings(spark, d)
    n = S.nearest(e.filter("label < 5").select("id", "vec"), e.filter("label >= 5").select("id", "vec"), DIM)
    return n.select("id", "match", F.round("score", 6).alias("score"))


@query(f"""WITH {_E} SELECT a.id, b.id AS match, CAST(row_number() OVER (PARTITION BY a.id ORDER BY round({_COS.format('a.v', 'b.v')}, 12) DESC, b.id) AS INTEGER) AS rank
FROM e a, e b WHERE a.id <> b.id QUALIFY rank <= 5""")
def knn_join(spark, d):
    e = embeddings(spark, d).select("id", "vec")
    n = S.nearest(e, e, DIM, k=6).filter("id <> match")
    w = W.partitionBy("id").orderBy(F.col("score").desc(), "match")
    return n.withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("id", "match", "rank")


@query(f"""WITH {_E}, k AS (SELECT a.id, b.id AS m, round({_COS.format('a.v', 'b.v')}, 12) AS s FROM e a JOIN e b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY s DESC, b.id) <= 20)
SELECT DISTINCT least(id, m) AS a, greatest(id, m) AS b, round(s, 6) AS score FROM k WHERE s >= 0.1""")
def neighbour_pairs(spark, d):
    return S.neighbour_pairs(embeddings(spark, d), DIM, 20, 0.1).withColumn("score", F.round("score", 6))


@query(f"""WITH {_E} SELECT a.id AS a, b.id AS b, round({_COS.format('a.v', 'b.v')}, 6) AS score FROM e a JOIN e b ON a.id < b.id ORDER BY round({_COS.format('a.v', 'b.v')}, 12) DESC, a.id, b.id LIMIT 100""")
def top_pairs(spark, d):
    return S.top_pairs(S.pairs(spark, embeddings(spark, d).select("id", "vec"), DIM, 0.0), 100).withColumn("score", F.round("score", 6))


@query("""WITH u AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
t AS (SELECT label, i, sum(CAST(x AS DOUBLE)) AS x FROM u GROUP BY label, i), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM t GROUP BY label)
SELECT label, CAST(i - 1 AS INTEGER) AS at, round(x / n, 6) AS x FROM t JOIN n USING (label)""")
def group_vector_sum(spark, d):
    g = embeddings(spark, d).groupBy("label").agg(V.vector_sum(F.col("vec")).alias("v"))
    return g.select("label", F.posexplode(V.normalize(F.col("v"))).alias("at", "x")).withColumn("x", F.round("x", 6))


@query("""WITH u AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT label, CAST(i - 1 AS INTEGER) AS at, round(avg(CAST(x AS DOUBLE)), 6) AS x FROM u GROUP BY label, i""")
def group_vector_mean(spark, d):
    g = embeddings(spark, d).groupBy("label").agg(V.vector_mean(F.col("vec")).alias("v"))
    return g.select("label", F.posexplode("v").alias("at", "x")).withColumn("x", F.round("x", 6))


@query(f"WITH {_S} SELECT a.id AS a, b.id AS b, round({_COS.format('a.v', 'b.v')}, 6) AS score FROM s a JOIN s b ON a.word = b.word AND a.pos = b.pos AND a.id < b.id WHERE {_COS.format('a.v', 'b.v')} >= 0.5")
def near_duplicate_senses(spark, d):
    return S.pairs_within(senses(spark, d), ["word", "pos"], DIM, 0.5).select("a", "b", F.round("score", 6).alias("score"))


@query(f"""WITH {_S}, u AS (SELECT word, pos, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM s),
m AS (SELECT word, pos, list(x ORDER BY i) AS m FROM (SELECT word, pos, i, avg(x) AS x FROM u GROUP BY word, pos, i) GROUP BY word, pos),
c AS (SELECT s.id, m.pos, {_COS.format('s.v', 'm.m')} AS score FROM s JOIN m ON s.word = m.word)
SELECT id, pos, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, pos) AS r FROM c) WHERE r = 1""")
def pos_resolution(spark, d):
    s = senses(spark, d)
    m = s.groupBy("word", "pos").agg(V.vector_mean(F.col("vec")).alias("m"))
    c = s.select("id", "word", "vec").join(m, "word").select("id", "pos", V.cosine(F.col("vec"), F.col("m")).alias("score"))
    return M.best_per_group(c, ["id"], F.round("score", 9).desc(), F.col("pos")).select("id", "pos", F.round("score", 6).alias("score"))


@query(f"""WITH {_E}, p AS (SELECT round({_COS.format('a.v', 'b.v')}, 6) AS score FROM e a JOIN e b ON a.id < b.id)
SELECT round(CASE WHEN score >= 0.4 THEN 0.4 ELSE floor(round(score * 100, 9)) / 100 END, 2) AS bucket, count(*) AS n FROM p WHERE score >= 0.3 GROUP BY 1""")
def threshold_histogram(spark, d):
    p = S.pairs(spark, embeddings(spark, d).select("id", "vec"), DIM, 0.29).withColumn("score", F.round("score", 6))
    return R.threshold_histogram(p, 0.4, 0.3)


@query(f"""WITH {_E}, k AS (SELECT a.id, a.label = b.label AS hit, row_number() OVER (PARTITION BY a.id ORDER BY round({_COS.format('a.v', 'b.v')}, 12) DESC, b.id) AS r FROM e a JOIN e b ON a.id <> b.id),
h AS (SELECT r.k AS method, k.id, max(CAST(k.hit AS INTEGER)) AS hit FROM k JOIN (VALUES (1), (5), (10)) r(k) ON k.r <= r.k GROUP BY r.k, k.id)
SELECT CAST(method AS INTEGER) AS method, round(avg(hit), 6) AS recall, count(*) AS n FROM h GROUP BY method""")
def recall_at_k(spark, d):
    e = embeddings(spark, d)
    n = S.nearest(e.select("id", "vec"), e.select("id", "vec"), DIM, k=11).filter("id <> match")
    n = n.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.col("score").desc(), "match")))
    n = n.join(e.select("id", F.col("label").alias("la")), "id").join(e.select(F.col("id").alias("match"), F.col("label").alias("lb")), "match")
    n = n.withColumn("method", F.explode(F.array(*[F.lit(k) for k in (1, 5, 10)]))).filter("rank <= method")
    hits = n.groupBy("method", "id").agg(F.max(F.col("la") == F.col("lb")).alias("hit"))
    return R.recall_at_k(hits).withColumn("recall", F.round("recall", 6))


# -- matching ----------------------------------------------------------------------------------------------------------


def _words_in_order(spark, d):
    w = R.last_wins(table(spark, d, "parsed_words").filter("word IS NOT NULL AND pos IS NOT NULL AND deleted_at IS NULL"), ["word", "pos"], "row_id")
    return w.select(F.concat_ws("|", "word", "pos").alias("id"), "word", "pos", F.col("row_id").alias("ord"))


_W = """w AS (SELECT word || '|' || pos AS id, word, pos, max(row_id) AS ord FROM parsed_words
  WHERE word IS NOT NULL AND pos IS NOT NULL AND deleted_at IS NULL GROUP BY word, pos)"""


def resolved_relations(spark, d) -> DataFrame:
    """Relations of words with their target: same word and part of speech first, else the first node of that word."""
    from nodeloom.plans.build import resolve_targets

    r = table(spark, d, "sense_relations").select("row_id", "kind", F.col("from_word").alias("word"), F.col("from_pos").alias("pos"), F.col("word").alias("target"))
    return resolve_targets(_words_in_order(spark, d), r)


@query(f"""WITH {_W}, f AS (SELECT word, arg_min(id, ord) AS first FROM w GROUP BY word)
SELECT r.row_id, r.kind, r.from_word || '|' || r.from_pos AS a, coalesce(x.id, f.first) AS b FROM sense_relations r
JOIN w o ON o.word = r.from_word AND o.pos = r.from_pos LEFT JOIN w x ON x.word = r.word AND x.pos = r.from_pos LEFT JOIN f ON f.word = r.word WHERE coalesce(x.id, f.first) IS NOT NULL""")
def relation_targets(spark, d):
    return resolved_relations(spark, d).select("row_id", "kind", "a", "b")


_TG = f"""{_W}, f AS (SELECT word, arg_min(id, ord) AS first FROM w GROUP BY word),
rt AS (SELECT r.row_id, r.kind, o.id AS a, o.ord AS ord_a, coalesce(x.id, f.first) AS b FROM sense_relations r
  JOIN w o ON o.word = r.from_word AND o.pos = r.from_pos LEFT JOIN w x ON x.word = r.word AND x.pos = r.from_pos LEFT JOIN f ON f.word = r.word),
tiers(tier, edge_type, kind, kind_at, q) AS (VALUES {", ".join(f"({p}, '{e}', '{k}', {i}, {SEEDS[s]})" for p, e, ks, s in TIERS for i, k in enumerate(ks))}),
p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY tier, ord_a, kind_at, row_id) AS n, a, b, CAST(tier AS INTEGER) AS tier, edge_type, CAST(q AS DOUBLE) AS q FROM rt JOIN tiers USING (kind) WHERE b IS NOT NULL AND a <> b),
g AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS b, 0 AS tier, '' AS edge_type, 0.5::DOUBLE AS q
  UNION ALL SELECT p.n, CASE WHEN list_contains(g.used, p.a) OR list_contains(g.used, p.b) THEN g.used ELSE list_concat(g.used, [p.a, p.b]) END,
    CASE WHEN list_contains(g.used, p.a) OR list_contains(g.used, p.b) THEN NULL ELSE p.a END, p.b, p.tier, p.edge_type, p.q FROM g JOIN p ON p.n = g.n + 1)"""


@query(f"WITH RECURSIVE {_TG} SELECT a, b, tier, edge_type, q FROM g WHERE a IS NOT NULL")
def tier_match(spark, d):
    from nodeloom.plans.build import tier_pairs

    return M.by_tiers(spark, tier_pairs(spark, resolved_relations(spark, d))).select("a", "b", "tier", "edge_type", "q")


def _scan(step: str) -> str:
    """A greedy scan in SQL over p (n, a, b, score)."""
    return f"""w AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS b, CAST(NULL AS DOUBLE) AS score
  UNION ALL SELECT p.n, CASE WHEN list_contains(w.used, p.a) OR list_contains(w.used, p.b) THEN w.used ELSE list_concat(w.used, [p.a, p.b]) END,
    CASE WHEN list_contains(w.used, p.a) OR list_contains(w.used, p.b) THEN NULL ELSE p.a END, p.b, p.score FROM w JOIN p ON p.n = w.n + 1),
{step} AS (SELECT a, b, score FROM w WHERE a IS NOT NULL)"""


_NORM = "list_transform({0}, lambda x: x / sqrt(list_sum(list_transform({0}, lambda y: y * y))))"


_FORM = f"""WITH RECURSIVE {_E}, c AS (SELECT format('{{:06d}}', id) AS id, v, 0.5 + label / 20 AS w, label FROM e),
p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY score DESC, a, b) AS n, a, b, score FROM (
  SELECT a.id AS a, b.id AS b, round({_COS.format('a.v', 'b.v')}, 12) AS score FROM c a JOIN c b ON a.id < b.id WHERE a.label < 5 AND b.label < 5) WHERE score >= 0.3),
{_scan('m')},
k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY m.score DESC, m.a, m.b) AS n, m.a, m.b, x.w AS wa, y.w AS wb, list_transform(list_zip(x.v, y.v), lambda z: z[1] + z[2]) AS z FROM m JOIN c x ON x.id = m.a JOIN c y ON y.id = m.b),
o AS MATERIALIZED (SELECT k.n, list(c.id ORDER BY round({_COS.format('k.z', 'c.v')}, 12) DESC, c.id) AS l FROM k, c WHERE c.label >= 5 GROUP BY k.n),
r AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS bridge
  UNION ALL SELECT o.n, list_append(r.used, list_filter(o.l, lambda x: NOT list_contains(r.used, x))[1]), list_filter(o.l, lambda x: NOT list_contains(r.used, x))[1] FROM r JOIN o ON o.n = r.n + 1),
t AS (SELECT k.a, k.b, r.bridge, k.wa, k.wb, c.w AS w3 FROM k JOIN r ON r.n = k.n JOIN c ON c.id = r.bridge)"""


@query(f"{_FORM} SELECT a || '|' || b AS pair, bridge FROM t")
def bridge_rounds(spark, d):
    """The bridges of ``triad_formation`` by rounds of offers, five candidates at first, none left to a task."""
    e = embeddings(spark, d).select(F.format_string("%06d", "id").alias("id"), "vec", "label")
    one, two = e.filter("label < 5").select("id", "vec"), e.filter("label >= 5").select("id", "vec")
    won = M.greedy_by_score(spark, S.pairs(spark, one, DIM, 0.3), 0.3)
    p = won.join(one.select(F.col("id").alias("a"), F.col("vec").alias("va")), "a").join(one.select(F.col("id").alias("b"), F.col("vec").alias("vb")), "b")
    p = M.ranked(p.select(F.concat_ws("|", "a", "b").alias("pair"), "score", "a", "b", V.neutral_edge_vector(F.col("va"), F.col("vb")).alias("vec")), -F.col("score"), F.col("a"), F.col("b"))
    p, _ = Scratch(spark, "bridge").cut(p)

    def near(ps: DataFrame, k: int) -> DataFrame:
        return S.nearest(ps.select(F.col("pair").alias("id"), "vec"), two, DIM, k).select(F.col("id").alias("pair"), F.col("match").alias("bridge"), "score", F.col("rank").alias("pref"))

    return M.assign_bridges(spark, p, near, two.count(), 5, 0).select("pair", "bridge")


@query(f"""{_FORM},
s AS (SELECT *, w3 * w3 / sqrt(wa ** 4 + wb ** 4 + w3 ** 4) AS q FROM t)
SELECT substr(sha256('11|' || a || '|' || b || '|' || bridge), 1, 24) AS id, a AS cm1_id, b AS cm2_id, bridge AS bridge_id, 11 AS level, round(q, 6) AS strength, round(q * (1 + 0.5 * (14 - 11) / 13.0), 6) AS weight FROM s""")
def triad_formation(spark, d):
    from nodeloom.plans.build import form_level

    e = embeddings(spark, d).select(F.format_string("%06d", "id").alias("id"), "vec", (F.lit(0.5) + F.col("label") / 20).alias("w"), "label")
    t = form_level(spark, e.filter("label < 5"), e.filter("label >= 5"), 13, 0.3, DIM)
    return t.select("id", "cm1_id", "cm2_id", "bridge_id", "level", F.round("connection_strength", 6).alias("strength"), F.round("accumulated_weight", 6).alias("weight"))


@query()
def sweep_extension(spark, d):
    from nodeloom.plans.build import sweep

    e = embeddings(spark, d).select(F.format_string("%06d", "id").alias("id"), "vec", F.lit(0.9).alias("w"), F.when(F.col("label") < 6, 14).otherwise(13).alias("level"))
    t, _ = sweep(spark, e, DIM, base=0.4, floor=lambda level: round(0.45 - 0.01 * level, 2))
    return t.select("id", "level", F.round("connection_strength", 6).alias("strength"))


_LP = f"""{_S}, n AS (SELECT *, list_transform(v, lambda x: x / sqrt({_DOT.format('v', 'v')})) AS u FROM s),
p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY score DESC, a, b) AS n, a, b, score FROM (
  SELECT a.id AS a, b.id AS b, round({_DOT.format('a.u', 'b.u')}, 12) AS score FROM n a JOIN n b ON a.id < b.id WHERE {_DOT.format('a.u', 'b.u')} >= 0.7199) WHERE score >= 0.72),
{_scan('m')}"""


@query(f"WITH RECURSIVE {_LP} SELECT a, b, round(score, 6) AS q FROM m")
def leaf_pairs(spark, d):
    from nodeloom.plans.build import leaf_pairs as pairs

    return pairs(spark, senses(spark, d), DIM, 0.72, 0.40).select("a", "b", F.round("q", 6).alias("q"))


@query(f"""WITH RECURSIVE {_LP},
e AS (SELECT substr(sha256('15|' || a || '|' || b), 1, 24) AS id, a, b, score, list_transform(list_zip(x.v, y.v), lambda z: z[1] + z[2]) AS z FROM m JOIN s x ON x.id = m.a JOIN s y ON y.id = m.b),
o AS (SELECT s.id, s.v FROM s WHERE s.id NOT IN (SELECT a FROM m UNION ALL SELECT b FROM m)),
r AS (SELECT o.id, e.id AS match, e.score FROM o, e QUALIFY row_number() OVER (PARTITION BY o.id ORDER BY round({_COS.format('o.v', 'e.z')}, 12) DESC, e.id) = 1)
SELECT id, a AS cm1_id, b AS cm2_id, round(score, 6) AS q FROM e UNION ALL SELECT substr(sha256('15|' || id || '|' || match), 1, 24), id, match, round(score, 6) FROM r""")
def leaf_edges_neutral(spark, d):
    from nodeloom.plans.build import leaf_stage

    return leaf_stage(spark, senses(spark, d), None, DIM, 0.72, 0.40).select("id", "cm1_id", "cm2_id", F.round("q", 6).alias("q"))


def _options():
    from nodeloom.options import Options

    return Options(dim=DIM)


@query()
def leaf_edges(spark, d):
    """The leaf stage as built: type texts of the words around, their vectors, weighted edge vectors, re-entry."""
    from nodeloom.plans.build import embedded_types, leaf_stage

    e = leaf_stage(spark, senses(spark, d), neighbourhoods(table(spark, d, "sense_relations")), DIM, 0.72, 0.40, embedded_types(_options()))
    return e.select("id", "cm1_id", "cm2_id", F.round("q", 6).alias("q"), "source", F.round(F.col("vec")[0], 6).alias("x1"), F.round(F.col("type_vec")[0], 6).alias("t1"))


def own_edges(spark, d):
    """Senses with the latest document's parent, and the edges of two senses with their neutral vectors."""
    g = docs(spark, d)
    n = g.filter("node_type = 'sense'").select("id", "sense_id", "word", "pos", "parent_edge_id")
    n = n.join(senses(spark, d).select(F.col("id").alias("sense_id"), "vec"), "sense_id").drop("sense_id")
    e = g.filter("doc_type <> 'node' AND level = 15").select("id", "cm1_id", "cm2_id")
    e = e.join(n.select(F.col("id").alias("cm1_id"), F.col("vec").alias("v1")), "cm1_id").join(n.select(F.col("id").alias("cm2_id"), F.col("vec").alias("v2")), "cm2_id")
    return g, n, e.select("id", V.neutral_edge_vector(F.col("v1"), F.col("v2")).alias("vec"))


_OE = f"""{_G}, {_S}, n AS (SELECT g.id, g.word, g.pos, g.parent_edge_id AS p, s.v FROM g JOIN s ON s.id = g.sense_id WHERE g.node_type = 'sense'),
z AS (SELECT g.id, list_transform(list_zip(a.v, b.v), lambda x: x[1] + x[2]) AS v FROM g JOIN n a ON a.id = g.cm1_id JOIN n b ON b.id = g.cm2_id WHERE g.doc_type <> 'node' AND g.level = 15),
ed AS (SELECT id, {_NORM.format('v')} AS v FROM z)"""


@query(f"""WITH {_OE}, w AS (SELECT id, word, pos FROM g WHERE node_type = 'word'),
c AS (SELECT DISTINCT w.id, ed.id AS part, ed.v FROM w JOIN n ON n.word = w.word AND n.pos = w.pos JOIN ed ON ed.id = n.p
  UNION ALL SELECT DISTINCT w.id, n.id, n.v FROM w JOIN n ON n.word = w.word AND n.pos = w.pos WHERE n.p IS NULL OR n.p = ''),
u AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM c), t AS (SELECT id, i, sum(x) AS x FROM u GROUP BY id, i), k AS (SELECT id, list(x ORDER BY i) AS v FROM t GROUP BY id)
SELECT id, round(({_NORM.format('v')})[1], 6) AS x1, round(({_NORM.format('v')})[64], 6) AS x64 FROM k""")
def word_vectors(spark, d):
    from nodeloom.plans.build import word_vectors as vectors

    g, n, e = own_edges(spark, d)
    v = vectors(g.filter("node_type = 'word'").select("id", "word", "pos"), n, e)
    return v.select("id", F.round(F.col("vec")[0], 6).alias("x1"), F.round(F.col("vec")[63], 6).alias("x64"))


@query(f"""WITH RECURSIVE {_TG}, s AS (SELECT sense_id AS id, word, pos, list_transform(vector, lambda x: CAST(x AS DOUBLE)) AS v FROM (
  SELECT *, row_number() OVER (PARTITION BY sense_id ORDER BY row_id) AS rn FROM parsed_senses
  WHERE sense_id IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(vector, lambda x: x <> 0)) > 0) WHERE rn = 1),
u AS (SELECT word || '|' || pos AS id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM s), t AS (SELECT id, i, sum(x) AS x FROM u GROUP BY id, i),
k AS (SELECT id, list(x ORDER BY i) AS v0 FROM t WHERE id IN (SELECT id FROM w) GROUP BY id), v AS (SELECT id, {_NORM.format('v0')} AS v FROM k),
m AS (SELECT substr(sha256('14|' || g.a || '|' || g.b), 1, 24) AS id, g.a, g.b, g.edge_type, g.q, list_transform(list_zip(x.v, y.v), lambda z: g.q * z[1] + g.q * z[2]) AS z FROM g JOIN v x ON x.id = g.a JOIN v y ON y.id = g.b WHERE g.a IS NOT NULL),
o AS (SELECT id, v FROM v WHERE id NOT IN (SELECT a FROM m UNION ALL SELECT b FROM m)),
r AS (SELECT o.id, m.id AS match, m.edge_type, m.q FROM o, m QUALIFY row_number() OVER (PARTITION BY o.id ORDER BY round({_COS.format('o.v', 'm.z')}, 12) DESC, m.id) = 1)
SELECT id, a AS cm1_id, b AS cm2_id, edge_type, q, 1.0::DOUBLE AS confidence, 'ingested' AS source FROM m
UNION ALL SELECT substr(sha256('14|' || id || '|' || match), 1, 24), id, match, edge_type, q, q, 'inferred' FROM r""")
def word_stage(spark, d):
    """The word stage with words at the sum of their senses and type vectors of zeros, so SQL can follow the nearest edges."""
    from nodeloom.options import TYPE_SENTENCES
    from nodeloom.plans.build import tier_pairs
    from nodeloom.plans.build import word_stage as stage

    v = senses(spark, d).groupBy(F.concat_ws("|", "word", "pos").alias("id")).agg(V.normalize(V.vector_sum(F.col("vec"))).alias("vec"))
    w = _words_in_order(spark, d).select("id").join(v, "id")
    types = spark.createDataFrame([(t,) for t in sorted(TYPE_SENTENCES)], "edge_type STRING").withColumn("type_vec", F.array_repeat(F.lit(0.0), DIM))
    e = stage(spark, w, M.by_tiers(spark, tier_pairs(spark, resolved_relations(spark, d))), types, DIM)
    return e.select("id", "cm1_id", "cm2_id", "edge_type", "q", "confidence", "source")


# -- texts, ids and upserts --------------------------------------------------------------------------------------------


@query("SELECT row_id, trim(concat_ws(' ', gloss, CASE WHEN len(examples) > 0 THEN array_to_string(examples[1:2], ' ') END)) AS t FROM parsed_senses")
def embed_texts(spark, d):
    return table(spark, d, "parsed_senses").select("row_id", X.embed_text(F.col("gloss"), F.col("examples")).alias("t"))


@query("SELECT row_id, coalesce(CASE WHEN sense_id <> '' THEN sense_id END, concat_ws('-', word, pos, CAST(sense_idx AS VARCHAR))) AS sid, word || ' (' || pos || ') [' || CAST(sense_idx AS VARCHAR) || ']' AS label FROM parsed_senses")
def sense_ids(spark, d):
    s = table(spark, d, "parsed_senses")
    return s.select("row_id", X.sense_id(F.col("sense_id"), F.col("word"), F.col("pos"), F.col("sense_idx")).alias("sid"), X.node_label(F.col("word"), F.col("pos"), F.col("sense_idx")).alias("label"))


@query("""WITH t AS (SELECT doc_id, text, CASE WHEN trim(source) <> '' AND lower(trim(source)) NOT IN ('(no doi)', 'no doi', 'n/a', 'none') THEN trim(source) END AS doi FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN doi IS NOT NULL THEN 'batch:' || doi || ':' || CAST(doc_id AS VARCHAR) ELSE 'batch:nodoi:' || CAST(doc_id AS VARCHAR) || ':' || substr(sha1(text), 1, 10) END AS sid FROM t""")
def term_ids(spark, d):
    t = table(spark, d, "documents").filter("text IS NOT NULL")
    return t.select("doc_id", X.term_sense_id(X.normalize_doi(F.col("source")), F.col("doc_id").cast("string"), F.col("text")).alias("sid"))


@query("""SELECT row_id, CASE WHEN list_max(dis1) > 0 THEN CAST(list_position(dis1, list_max(dis1)) - 1 AS INTEGER) END AS idx,
coalesce(array_to_string(dis1, ' '), '') AS back FROM sense_relations""")
def weight_argmax(spark, d):
    r = table(spark, d, "sense_relations").withColumn("t", F.array_join(F.col("dis1").cast("array<string>"), " "))
    w = X.parse_weights(F.col("t"))
    return r.select("row_id", X.argmax_weight(w).alias("idx"), F.array_join(w.cast("array<string>"), " ").alias("back"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT word, pos, row_id, lang_code FROM parsed_words QUALIFY row_number() OVER (PARTITION BY word, pos ORDER BY row_id DESC) = 1")
def upsert_words(spark, d):
    return R.last_wins(table(spark, d, "parsed_words"), ["word", "pos"], "row_id").select("word", "pos", "row_id", "lang_code")


@query("SELECT sense_id, row_id, gloss FROM parsed_senses QUALIFY row_number() OVER (PARTITION BY sense_id ORDER BY row_id DESC) = 1")
def upsert_senses(spark, d):
    return R.last_wins(table(spark, d, "parsed_senses").select("sense_id", "row_id", "gloss"), ["sense_id"], "row_id")


@query("""WITH t AS (SELECT doc_id, trim(regexp_replace(headword, '\\s+', ' ', 'g')) AS h, text, source FROM documents)
SELECT h AS norm_term, text, min(doc_id) AS doc_id, coalesce(array_to_string(list_sort(list(DISTINCT source) FILTER (source IS NOT NULL)), ','), '') AS sources FROM t GROUP BY h, text""")
def exact_dedup_union(spark, d):
    t = table(spark, d, "documents").select("doc_id", "headword", "text", "source")
    return R.dedupe_union(t, "headword", "text", "source", "doc_id").select("norm_term", "text", "doc_id", F.array_join("sources", ",").alias("sources"))


@query("SELECT DISTINCT least(from_word, word) AS a, greatest(from_word, word) AS b FROM sense_relations WHERE kind = 'synonyms' AND from_word <> word")
def canonical_pairs(spark, d):
    return R.unordered_pairs(table(spark, d, "sense_relations").filter("kind = 'synonyms'"), "from_word", "word")


@query("SELECT row_id, from_word, word FROM sense_relations WHERE kind = 'synonyms' AND word <> from_word AND word IN (SELECT word FROM parsed_words WHERE word IS NOT NULL)")
def known_targets(spark, d):
    w = table(spark, d, "parsed_words").select("word").distinct()
    return table(spark, d, "sense_relations").filter("kind = 'synonyms' AND word <> from_word").join(w, "word", "left_semi").select("row_id", "from_word", "word")


@query("""WITH g AS (SELECT word, arg_min(gloss, row_id) AS gloss FROM parsed_senses WHERE gloss <> '' GROUP BY word)
SELECT w.row_id, w.word, coalesce(g.gloss, w.word) AS gloss FROM parsed_words w LEFT JOIN g ON g.word = w.word""")
def gloss_or_word(spark, d):
    g = table(spark, d, "parsed_senses").filter("gloss <> ''").groupBy("word").agg(F.min_by("gloss", "row_id").alias("g"))
    return table(spark, d, "parsed_words").select("row_id", "word").join(g, "word", "left").select("row_id", "word", F.coalesce("g", "word").alias("gloss"))


@query("SELECT word, count(DISTINCT pos) AS n_pos, array_to_string(list_sort(list(DISTINCT pos)), ',') AS pos FROM parsed_words WHERE word IS NOT NULL AND pos IS NOT NULL GROUP BY word HAVING count(DISTINCT pos) > 1")
def homonyms(spark, d):
    w = table(spark, d, "parsed_words").filter("word IS NOT NULL AND pos IS NOT NULL").groupBy("word").agg(F.collect_set("pos").alias("p"))
    return w.filter(F.size("p") > 1).select("word", F.size("p").cast("bigint").alias("n_pos"), F.array_join(F.array_sort("p"), ",").alias("pos"))


@query(f"""WITH {_W}, r AS (SELECT from_word AS word, from_pos AS pos, string_agg(word, ', ' ORDER BY row_id) FILTER (kind = 'antonyms') AS ant, string_agg(word, ', ' ORDER BY row_id) FILTER (kind = 'synonyms') AS syn
  FROM sense_relations WHERE word <> '' GROUP BY from_word, from_pos),
t AS (SELECT w.id, w.word, concat_ws('; ', 'antonyms: ' || r.ant, 'synonyms: ' || r.syn) AS g FROM w LEFT JOIN r ON r.word = w.word AND r.pos = w.pos)
SELECT id, CASE WHEN g <> '' THEN word || ' (' || g || ')' ELSE word END || '; ' || word AS t FROM t""")
def type_texts(spark, d):
    n = neighbourhoods(table(spark, d, "sense_relations"))
    w = _words_in_order(spark, d).join(n, ["word", "pos"], "left")
    none = F.array().cast("array<string>")
    return w.select("id", X.edge_type_text(F.col("word"), F.coalesce("ant", none), F.coalesce("syn", none), F.col("word"), none, none).alias("t"))


def neighbourhoods(relations: DataFrame) -> DataFrame:
    """(word, pos, ant, syn): antonyms and synonyms of each word in stored order, blank ones left out."""
    r = relations.filter("kind IN ('antonyms', 'synonyms') AND word <> ''").select(F.col("from_word").alias("w"), F.col("from_pos").alias("p"), "kind", F.struct("row_id", "word").alias("x"))

    def of(k: str):
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("x")))), lambda x: x["word"])

    return r.groupBy(F.col("w").alias("word"), F.col("p").alias("pos")).agg(of("antonyms").alias("ant"), of("synonyms").alias("syn"))


# -- statistics and lookups --------------------------------------------------------------------------------------------


@query(f"WITH {_G} SELECT doc_type, level, node_type, edge_type, count(*) AS n FROM g GROUP BY ALL")
def graph_breakdown(spark, d):
    return R.breakdown(docs(spark, d))


@query(f"WITH {_G} SELECT doc_type, level, count(*) AS total, sum(CASE WHEN parent_edge_id IS NULL OR parent_edge_id = '' THEN 1 ELSE 0 END)::BIGINT AS orphans, round(100.0 * sum(CASE WHEN parent_edge_id IS NULL OR parent_edge_id = '' THEN 1 ELSE 0 END) / count(*), 1) AS pct FROM g GROUP BY ALL")
def graph_orphans(spark, d):
    return R.orphan_stats(docs(spark, d))


@query(f"WITH {_G} SELECT doc_type, level, count(*) AS n FROM g GROUP BY ALL")
def documents_by_level(spark, d):
    return docs(spark, d).groupBy("doc_type", "level").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_G} SELECT node_type, count(*) AS n FROM g WHERE doc_type = 'node' GROUP BY ALL")
def nodes_by_type(spark, d):
    return docs(spark, d).filter("doc_type = 'node'").groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_G} SELECT level, coalesce(edge_type, '(null)') AS edge_type, count(*) AS n FROM g WHERE doc_type <> 'node' AND level >= 14 GROUP BY ALL")
def edges_by_type(spark, d):
    e = docs(spark, d).filter("doc_type <> 'node' AND level >= 14")
    return e.groupBy("level", F.coalesce("edge_type", F.lit("(null)")).alias("edge_type")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_G} SELECT level, count(*) AS n FROM g WHERE doc_type <> 'node' AND level <= 13 GROUP BY ALL")
def triads_by_level(spark, d):
    return docs(spark, d).filter("doc_type <> 'node' AND level <= 13").groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_G} SELECT doc_type, level, count(*) AS n FROM g WHERE parent_edge_id IS NULL OR parent_edge_id = '' GROUP BY ALL")
def orphans_by_level(spark, d):
    o = docs(spark, d).filter("parent_edge_id IS NULL OR parent_edge_id = ''")
    return o.groupBy("doc_type", "level").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_G} SELECT source, count(*) AS n FROM g WHERE doc_type <> 'node' AND level IN (14, 15) GROUP BY ALL")
def edges_by_source(spark, d):
    return docs(spark, d).filter("doc_type <> 'node' AND level IN (14, 15)").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(DISTINCT id) AS n FROM graph_docs")
def document_count(spark, d):
    return docs(spark, d).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_G} SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n FROM (SELECT rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2.0 AS rx, rank() OVER (ORDER BY confidence) + (count(*) OVER (PARTITION BY confidence) - 1) / 2.0 AS ry FROM g WHERE q IS NOT NULL AND confidence IS NOT NULL)")
def spearman_rank(spark, d):
    return R.spearman(docs(spark, d), "q", "confidence").withColumn("rho", F.round("rho", 6))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 50 OFFSET 100")
def page_offset(spark, d):
    return R.page(table(spark, d, "events").select("event_id", "user_id", "event_type"), "event_id", 50, 100)


@query("""SELECT word, pos, sense_idx, left(gloss, 100) AS gloss, len(examples) > 0 AS has_examples FROM parsed_senses WHERE word IS NOT NULL ORDER BY word, sense_idx, row_id""")
def word_senses(spark, d):
    s = table(spark, d, "parsed_senses").filter("word IS NOT NULL").orderBy("word", "sense_idx", "row_id")
    return s.select("word", "pos", "sense_idx", F.substring("gloss", 1, 100).alias("gloss"), (F.size("examples") > 0).alias("has_examples"))


@query("SELECT row_id, word, pos, (deleted_at IS NOT NULL) AS gone, CASE WHEN etymology <> '' THEN left(etymology, 150) END AS etymology, coalesce(array_to_string(forms[1:6], ','), '') AS forms FROM parsed_words")
def word_projection(spark, d):
    return table(spark, d, "parsed_words").select("row_id", "word", "pos", F.col("deleted_at").isNotNull().alias("gone"), F.when(F.col("etymology") != "", F.substring("etymology", 1, 150)).alias("etymology"), F.coalesce(F.array_join(F.slice("forms", 1, 6), ","), F.lit("")).alias("forms"))


@query("SELECT r.row_id, r.word FROM sense_relations r WHERE r.sense_id IN (SELECT sense_id FROM knn_probes)")
def scoped_relations(spark, d):
    return table(spark, d, "sense_relations").join(table(spark, d, "knn_probes"), "sense_id", "left_semi").select("row_id", "word")


@query("SELECT DISTINCT word FROM sense_relations WHERE word IS NOT NULL EXCEPT SELECT word FROM parsed_words")
def missing_targets(spark, d):
    r = table(spark, d, "sense_relations").filter("word IS NOT NULL").select("word").distinct()
    return r.join(table(spark, d, "parsed_words").select("word"), "word", "left_anti")


@query(f"WITH {_G} SELECT id, level, parent_edge_id FROM g WHERE doc_type <> 'node' AND level BETWEEN 10 AND 13 ORDER BY md5('7|' || id), id LIMIT 50")
def sampled_triads(spark, d):
    t = docs(spark, d).filter("doc_type <> 'node' AND level BETWEEN 10 AND 13").select("id", "level", "parent_edge_id")
    return R.sample_rows(t, 50, "id", 7)


def _dictionary_sql(senses: bool) -> str:
    """Typed reading in SQL: a field of another shape than declared is null, what is no record is none."""
    from nodeloom.operators.nested import RELATIONS

    def text(of: str, path: str) -> str:
        return f"CASE json_type({of}, '{path}') WHEN 'NULL' THEN NULL ELSE json_extract_string({of}, '{path}') END"

    def array(of: str, path: str, kind: str) -> str:
        l = f"json_extract({of}, '{path}[*]')"
        return f"CASE WHEN json_type({of}, '{path}') = 'ARRAY' AND len(list_filter({l}, lambda x: json_type(x) NOT IN ('{kind}', 'NULL'))) = 0 THEN {l} END"

    rel = " + ".join(f"coalesce(len(list_filter({array('j', '$.' + k, 'OBJECT')}, lambda x: coalesce(json_extract_string(x, '$.word'), '') <> '')), 0)" for k in RELATIONS)
    head = f"""WITH v AS (SELECT line_id AS ord, CASE WHEN json_valid(line) THEN CASE WHEN json_type(line) = 'OBJECT' THEN CAST(line AS JSON) END END AS j FROM kaikki_lines),
r AS (SELECT ord, j, {text('j', '$.word')} AS word, {text('j', '$.pos')} AS pos, coalesce({text('j', '$.lang_code')}, 'en') AS lang, {array('j', '$.senses', 'OBJECT')} AS l, {rel} AS n_relations, {array('j', '$.sounds', 'OBJECT')} AS snd FROM v WHERE j IS NOT NULL),
e AS (SELECT ord, word, pos, n_relations, snd, unnest(l) AS s, CAST(unnest(generate_series(0, len(l) - 1)) AS INTEGER) AS sense_idx FROM r WHERE word <> '' AND pos <> '' AND lang = 'en' AND len(l) > 0),
g AS (SELECT *, {array('s', '$.glosses', 'VARCHAR')} AS gl FROM e), k AS (SELECT *, json_extract_string(gl[1], '$') AS gloss FROM g WHERE json_type(gl[1]) = 'VARCHAR' AND json_extract_string(gl[1], '$') <> '')"""
    if not senses:
        ipa = "list_filter(coalesce(any_value(snd), []), lambda x: coalesce(json_extract_string(x, '$.ipa'), '') <> '')"
        return f"""{head} SELECT ord, word, pos, coalesce(json_extract_string(list_filter({ipa}, lambda x: coalesce(json_array_length(x, '$.tags'), 0) = 0)[1], '$.ipa'), json_extract_string({ipa}[1], '$.ipa')) AS ipa,
CAST(count(*) AS INTEGER) AS n_senses, CAST(any_value(n_relations) AS INTEGER) AS n_relations FROM k GROUP BY ord, word, pos"""
    ex = f"list_filter(list_transform(coalesce({array('s', '$.examples', 'OBJECT')}, []), lambda x: json_extract_string(x, '$.text')), lambda t: t <> '')"
    return f"""{head} SELECT ord, coalesce(CASE WHEN json_extract_string(s, '$.id') <> '' THEN json_extract_string(s, '$.id') END, concat_ws('-', word, pos, CAST(sense_idx AS VARCHAR))) AS sense_id, sense_idx, gloss,
trim(concat_ws(' ', gloss, CASE WHEN len({ex}) > 0 THEN array_to_string({ex}[1:2], ' ') END), ' ') AS embed_text FROM k"""


@query(lambda: _dictionary_sql(False))
def dictionary_words(spark, d):
    from nodeloom.sources.dictionary import parse_lines

    w, _ = parse_lines(table(spark, d, "kaikki_lines").select(F.col("line_id").alias("ord"), F.col("line").alias("value")))
    return w.select("ord", "word", "pos", "ipa", F.size("sense_ids").alias("n_senses"), F.size("relations").alias("n_relations"))


@query(lambda: _dictionary_sql(True))
def dictionary_senses(spark, d):
    from nodeloom.sources.dictionary import parse_lines

    _, s = parse_lines(table(spark, d, "kaikki_lines").select(F.col("line_id").alias("ord"), F.col("line").alias("value")))
    return s.select("ord", "sense_id", "sense_idx", "gloss", "embed_text")


@query(f"""WITH RECURSIVE {_S.replace("s AS", "s0 AS", 1)}, cw AS (SELECT word, min(pos) AS pos FROM core_words GROUP BY word HAVING count(DISTINCT pos) = 1),
s AS (SELECT s0.id, s0.v, s0.word, coalesce(cw.pos, 'noun') AS pos, cw.word IS NOT NULL AS old, r.ord FROM s0 JOIN (SELECT sense_id, min(row_id) AS ord FROM parsed_senses GROUP BY sense_id) r ON r.sense_id = s0.id LEFT JOIN cw ON cw.word = s0.word WHERE s0.word IS NOT NULL),
e AS (SELECT b.id AS late, b.ord, a.id AS early, a.ord AS eo, round({_COS.format('a.v', 'b.v')}, 12) AS score FROM s a JOIN s b ON a.word = b.word AND a.ord < b.ord WHERE {_COS.format('a.v', 'b.v')} >= 0.7),
p AS MATERIALIZED (SELECT late, list(early) AS es, row_number() OVER (ORDER BY min(ord)) AS n FROM e GROUP BY late),
w AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS merged UNION ALL SELECT p.n, CASE WHEN len(list_filter(p.es, lambda x: NOT list_contains(w.merged, x))) > 0 THEN list_append(w.merged, p.late) ELSE w.merged END FROM w JOIN p ON p.n = w.n + 1),
m AS (SELECT unnest(merged) AS id FROM (SELECT merged FROM w ORDER BY n DESC LIMIT 1)), t AS (SELECT late, arg_min(early, (-score, eo)) AS early FROM e WHERE early NOT IN (SELECT id FROM m) GROUP BY late)
SELECT s.id AS sense_id, s.word, s.pos, CASE WHEN m.id IS NOT NULL THEN 'merged' WHEN NOT s.old AND s.ord = min(s.ord) OVER (PARTITION BY s.word, s.old) THEN 'new_word' ELSE 'new_sense' END AS outcome, CASE WHEN m.id IS NOT NULL THEN t.early END AS merged_into
FROM s LEFT JOIN m ON m.id = s.id LEFT JOIN t ON t.late = s.id""")
def batch_ingest(spark, d):
    """All senses as a batch of terms with their own vectors, into a graph of the core words (those of one part of speech)."""
    from nodeloom.plans.ingest import settle

    s = table(spark, d, "parsed_senses").groupBy("sense_id").agg(F.min("row_id").alias("ord"))
    t = senses(spark, d).join(s, F.col("id") == F.col("sense_id")).select("ord", "word", "sense_id", F.lit("").alias("gloss"), F.array().cast("array<string>").alias("dois"), "vec")
    w = table(spark, d, "core_words").groupBy("word").agg(F.min("pos").alias("pos"), F.count_distinct("pos").alias("n")).filter("n = 1")
    w = w.select("word", "pos", F.lit(1).alias("ord"), F.lit(None).cast("array<double>").alias("vec"))
    none = spark.createDataFrame([], "id STRING, word STRING, pos STRING, vec ARRAY<DOUBLE>")
    return settle(spark, t.withColumn("vec", V.doubles(F.col("vec"))), w, none, DIM, 0.7).select("sense_id", "word", "pos", "outcome", "merged_into")


def _label_sql() -> str:
    from nodeloom.plans.labels import SYSTEM

    return f"""{_TV}, l AS (SELECT id, branch, list_sort(list(word))[1:10] AS ws FROM (SELECT top AS id, branch, word FROM tl) GROUP BY id, branch),
b AS (SELECT id, coalesce(max(array_to_string(ws, ', ')) FILTER (branch = 'child1'), '') AS c1, coalesce(max(array_to_string(ws, ', ')) FILTER (branch = 'child2'), '') AS c2, coalesce(max(array_to_string(ws, ', ')) FILTER (branch = 'bridge'), '') AS br FROM l GROUP BY id)
SELECT e.id AS key, CAST(json_object('key', e.id, 'request', json_object('system_instruction', json_object('role', 'system', 'parts', [json_object('text', '{SYSTEM}')]),
 'contents', [json_object('role', 'user', 'parts', [json_object('text', format('level {{}}, strength {{}}' || chr(10) || 'A: {{}}' || chr(10) || 'B: {{}}' || chr(10) || 'bridge: {{}}', e.level, CAST(CAST(round(CAST(coalesce(e.connection_strength, 0.0) AS DECIMAL(18, 9)), 3) AS DECIMAL(18, 3)) AS VARCHAR), coalesce(b.c1, ''), coalesce(b.c2, ''), coalesce(b.br, '')))])],
 'generationConfig', json_object('responseMimeType', 'application/json', 'maxOutputTokens', 1024, 'temperature', 0.2::DOUBLE, 'frequencyPenalty', 0.0::DOUBLE, 'thinkingConfig', json_object('thinkingBudget', 0)))) AS VARCHAR) AS line
FROM g e LEFT JOIN b ON b.id = e.id WHERE e.doc_type <> 'node' AND e.level <= 13"""


@query(_label_sql)
def label_requests(spark, d):
    from nodeloom.plans.labels import requests

    g = docs(spark, d)
    return requests(spark, g, g.filter("doc_type <> 'node' AND level <= 13").select("id"))


@query("""WITH k AS (SELECT DISTINCT word FROM parsed_words WHERE word IS NOT NULL),
p AS (SELECT DISTINCT least(from_word, word) AS a, greatest(from_word, word) AS b FROM sense_relations WHERE kind = 'synonyms' AND from_word <> word),
q AS (SELECT a, b FROM p WHERE a IN (SELECT word FROM k) AND b IN (SELECT word FROM k)), g AS (SELECT word, arg_min(gloss, row_id) AS gloss FROM parsed_senses WHERE gloss <> '' GROUP BY word)
SELECT a AS word_a, coalesce(g.gloss, a) AS gloss_a, b AS word_b FROM (SELECT * FROM q QUALIFY row_number() OVER (ORDER BY md5('13|' || a || '|' || b), a, b) <= greatest(1, round((SELECT count(*) FROM q) * 0.1))) q LEFT JOIN g ON g.word = q.a""")
def holdout_pairs(spark, d):
    from nodeloom.plans.evaluate import holdout

    return holdout(table(spark, d, "sense_relations"), table(spark, d, "parsed_words"), table(spark, d, "parsed_senses"), 0.1)


# -- closures ----------------------------------------------------------------------------------------------------------

_DOWN = f"""WITH RECURSIVE {_G}, k AS (SELECT id AS p, unnest([cm1_id, cm2_id]) AS c FROM g WHERE doc_type <> 'node'), kk AS (SELECT p, c FROM k JOIN g ON g.id = k.c),
t AS (SELECT id AS start, id, 0 AS depth FROM g WHERE doc_type <> 'node' UNION SELECT t.start, kk.c, t.depth + 1 FROM t JOIN kk ON kk.p = t.id WHERE t.depth < 15)"""


def _edge_starts(g):
    return g.filter("doc_type <> 'node'").select(F.col("id").alias("start"), "id")


@query(f"{_DOWN}, l AS (SELECT DISTINCT t.start, g.word FROM t JOIN g ON g.id = t.id WHERE g.doc_type = 'node' AND g.word IS NOT NULL) SELECT start, array_to_string(list_sort(list(word)), ',') AS words FROM l GROUP BY start")
def leaf_words(spark, d):
    g = docs(spark, d)
    return G.leaf_words(spark, g, _edge_starts(g)).select("start", F.array_join("words", ",").alias("words"))


@query(f"{_DOWN} SELECT t.start, count(DISTINCT CASE WHEN g.node_type = 'sense' THEN g.id END) AS senses, count(DISTINCT CASE WHEN g.node_type = 'word' THEN g.id END) AS words FROM t JOIN g ON g.id = t.id WHERE g.doc_type = 'node' GROUP BY t.start")
def leaf_counts(spark, d):
    g = docs(spark, d)
    l = G.leaf_documents(spark, g, _edge_starts(g))
    return l.groupBy("start").agg(F.sum(F.when(F.col("node_type") == "sense", 1).otherwise(0)).alias("senses"), F.sum(F.when(F.col("node_type") == "word", 1).otherwise(0)).alias("words"))


_BR = """e AS (SELECT id, cm1_id, cm2_id, CASE WHEN bridge_id <> '' THEN bridge_id END AS given FROM g WHERE doc_type <> 'node' AND level <= 13),
br AS (SELECT e.id, coalesce(any_value(e.given), min(CASE WHEN b.id IS DISTINCT FROM e.cm1_id AND b.id IS DISTINCT FROM e.cm2_id THEN b.id END)) AS bridge FROM e LEFT JOIN g b ON b.parent_edge_id = e.id GROUP BY e.id)"""


@query(f"WITH {_G}, {_BR} SELECT id, bridge FROM br")
def triad_bridges(spark, d):
    return G.bridges(docs(spark, d))


_TV = f"""WITH RECURSIVE {_G}, k AS (SELECT id AS p, unnest([cm1_id, cm2_id]) AS c FROM g WHERE doc_type <> 'node'), kk AS (SELECT p, c FROM k JOIN g ON g.id = k.c), {_BR},
st AS (SELECT id AS top, 'child1' AS branch, cm1_id AS id FROM e UNION ALL SELECT id, 'child2', cm2_id FROM e UNION ALL SELECT id, 'bridge', bridge FROM br),
t AS (SELECT st.top, st.branch, st.id, 0 AS depth FROM st JOIN g ON g.id = st.id UNION SELECT t.top, t.branch, kk.c, t.depth + 1 FROM t JOIN kk ON kk.p = t.id WHERE t.depth < 15),
tl AS (SELECT DISTINCT t.top, t.branch, g.word FROM t JOIN g ON g.id = t.id WHERE g.doc_type = 'node' AND g.word IS NOT NULL)"""


@query(f"{_TV} SELECT top AS id, branch, array_to_string(list_sort(list(word)), ',') AS words FROM tl GROUP BY top, branch")
def triad_views(spark, d):
    g = docs(spark, d)
    t = g.filter("doc_type <> 'node' AND level <= 13").select("id")
    return G.triad_view(spark, g, t).select("id", "branch", F.array_join("words", ",").alias("words"))


@query(f"""WITH RECURSIVE {_G}, u AS (SELECT a.id, a.parent_edge_id AS p FROM g a JOIN g b ON b.id = a.parent_edge_id),
t AS (SELECT id AS start, 0 AS step, id, [id] AS path FROM g UNION ALL SELECT t.start, t.step + 1, u.p, list_append(t.path, u.p) FROM t JOIN u ON u.id = t.id WHERE t.step < 6 AND NOT list_contains(t.path, u.p))
SELECT start, CAST(step AS INTEGER) AS step, id FROM t WHERE step > 0""")
def ancestors(spark, d):
    g = docs(spark, d)
    return G.ancestors(spark, g, g.select("id"), 6)


@query(f"""WITH RECURSIVE {_G}, u AS (SELECT a.id, b.id AS p FROM g a JOIN g b ON b.id = a.parent_edge_id),
h AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM g WHERE doc_type = 'node'),
t AS (SELECT CAST(0 AS BIGINT) AS n, 0 AS step, CAST(NULL AS VARCHAR) AS id, true AS pointer, (SELECT list(id) FROM h) AS met
  UNION ALL SELECT CASE WHEN x.up THEN x.n ELSE x.n + 1 END, CASE WHEN x.up THEN x.step + 1 ELSE 0 END, CASE WHEN x.up THEN x.p ELSE h.id END, x.up AND list_contains(x.met, x.p), CASE WHEN x.up AND NOT list_contains(x.met, x.p) THEN list_append(x.met, x.p) ELSE x.met END
  FROM (SELECT t.n, t.step, t.met, u.p, (NOT t.pointer AND t.step < 20 AND u.p IS NOT NULL) AS up FROM t LEFT JOIN u ON u.id = t.id) x LEFT JOIN h ON h.n = x.n + 1 WHERE x.up OR h.id IS NOT NULL)
SELECT h.id AS hit, t.step, t.id, t.pointer FROM t JOIN h ON h.n = t.n WHERE t.step > 0""")
def ancestor_chains(spark, d):
    g = docs(spark, d)
    hits = g.filter("doc_type = 'node'").select(F.col("id").alias("hit"), "id")
    return G.ancestor_chains(spark, g, hits)


_EW = f"WITH {_G}, w AS (SELECT id AS word_id FROM g WHERE node_type = 'word'), e AS (SELECT id, cm1_id, cm2_id, edge_type, q FROM g WHERE doc_type <> 'node' AND level = 14)"


@query(f"""{_EW}, x AS (SELECT w.word_id, e.id AS edge_id, e.cm2_id AS partner_id, e.edge_type, e.q FROM w JOIN e ON e.cm1_id = w.word_id UNION ALL
SELECT w.word_id, e.id, e.cm1_id, e.edge_type, e.q FROM w JOIN e ON e.cm2_id = w.word_id AND e.cm2_id IS DISTINCT FROM e.cm1_id)
SELECT x.*, CASE WHEN g.doc_type = 'node' THEN g.label ELSE g.doc_type END AS partner_label FROM x LEFT JOIN g ON g.id = x.partner_id""")
def word_edges(spark, d):
    g = docs(spark, d)
    return G.edges_of_words(g, g.filter("node_type = 'word'").select(F.col("id").alias("word_id")))


@query(f"""{_EW}, u AS (SELECT unnest([cm1_id, cm2_id]) AS word_id FROM e), c AS (SELECT word_id, count(*) AS n FROM u GROUP BY word_id) SELECT w.word_id, coalesce(c.n, 0) AS degree FROM w LEFT JOIN c ON c.word_id = w.word_id""")
def word_degrees(spark, d):
    g = docs(spark, d)
    return G.word_degrees(g, g.filter("node_type = 'word'").select(F.col("id").alias("word_id")))


@query(f"""WITH {_G}, w AS (SELECT id, word, pos FROM g WHERE node_type = 'word'), s AS (SELECT word, pos, id, parent_edge_id AS p FROM g WHERE node_type = 'sense')
SELECT w.id, count(DISTINCT CASE WHEN e.id IS NOT NULL THEN e.id END) AS edges, count(DISTINCT CASE WHEN s.id IS NOT NULL AND (s.p IS NULL OR s.p = '') THEN s.id END) AS orphan_senses
FROM w LEFT JOIN s ON s.word = w.word AND s.pos = w.pos LEFT JOIN g e ON e.id = s.p AND e.doc_type <> 'node' GROUP BY w.id""")
def word_sources(spark, d):
    from nodeloom.plans.build import word_constituents

    g = docs(spark, d)
    w = g.filter("node_type = 'word'").select("id", "word", "pos")
    c = word_constituents(w, g.filter("node_type = 'sense'"), g.filter("doc_type <> 'node'").select(F.col("id").alias("edge_id")))
    n = c.groupBy("word_id").agg(F.sum(F.when(F.col("kind") == "edge", 1).otherwise(0)).alias("edges"), F.sum(F.when(F.col("kind") == "sense", 1).otherwise(0)).alias("orphan_senses"))
    return w.select("id").join(n, F.col("id") == F.col("word_id"), "left").select("id", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("orphan_senses", F.lit(0)).alias("orphan_senses"))


@query(f"""{_DOWN}, l AS (SELECT DISTINCT t.start, g.word FROM t JOIN g ON g.id = t.id WHERE g.doc_type = 'node' AND g.word IS NOT NULL),
ws AS (SELECT start, list(word) AS ws FROM l GROUP BY start), e AS (SELECT id, cm1_id, cm2_id FROM g WHERE doc_type <> 'node' AND level <= 13)
SELECT e.id, len(list_intersect(a.ws, b.ws)) AS overlap, round(len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))), 6) AS jaccard FROM e JOIN ws a ON a.start = e.cm1_id JOIN ws b ON b.start = e.cm2_id""")
def child_overlap(spark, d):
    g = docs(spark, d)
    e = g.filter("doc_type <> 'node' AND level <= 13").select("id", F.col("cm1_id").alias("a"), F.col("cm2_id").alias("b"))
    return G.word_overlaps(spark, g, e).select("id", "overlap", F.round("jaccard", 6).alias("jaccard"))


# -- provenance --------------------------------------------------------------------------------------------------------


def _sense_prov(spark, d):
    g = docs(spark, d)
    s = table(spark, d, "parsed_senses").select("sense_id", "doi").join(g.filter("node_type = 'sense'").select("id", "sense_id"), "sense_id")
    return g, P.register(None, s)


_PV = """p AS (SELECT DISTINCT x.doi, g.id AS node_id FROM (SELECT sense_id, unnest(doi) AS doi FROM parsed_senses) x JOIN g ON g.sense_id = x.sense_id AND g.node_type = 'sense' WHERE trim(x.doi) <> '')"""


@query(f"WITH {_G}, {_PV} SELECT doi, node_id FROM p")
def provenance_register(spark, d):
    return _sense_prov(spark, d)[1]


@query(f"""WITH {_G}, {_PV}, m AS (SELECT id AS new_id, unnest([cm1_id, cm2_id]) AS part_id FROM g WHERE doc_type <> 'node')
SELECT doi, node_id FROM p UNION SELECT p.doi, m.new_id FROM m JOIN p ON p.node_id = m.part_id""")
def provenance_propagate(spark, d):
    g, p = _sense_prov(spark, d)
    made = g.filter("doc_type <> 'node'").select(F.col("id").alias("new_id"), F.explode(F.array("cm1_id", "cm2_id")).alias("part_id"))
    return P.propagate(p, made)


@query(f"""WITH RECURSIVE {_G}, {_PV}, u AS (SELECT a.id, a.parent_edge_id AS p FROM g a JOIN g b ON b.id = a.parent_edge_id),
t AS (SELECT doi, node_id FROM p UNION SELECT t.doi, u.p FROM t JOIN u ON u.id = t.node_id) SELECT doi, node_id FROM t""")
def provenance_up(spark, d):
    g, p = _sense_prov(spark, d)
    return P.propagate_up_chain(spark, p, g, p.select(F.col("node_id").alias("id")))


@query(f"WITH {_G}, {_PV} SELECT node_id AS id, array_to_string(list_sort(list(doi)), ',') AS dois FROM p GROUP BY node_id")
def provenance_lookup(spark, d):
    g, p = _sense_prov(spark, d)
    return P.dois_of(p, g.select("id")).select("id", F.array_join("dois", ",").alias("dois"))
