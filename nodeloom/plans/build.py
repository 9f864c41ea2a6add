"""Construction of the graph: leaf edges, word vectors, relation tiers, triads and the relaxation sweep.

Every stage is a function from frames to frames; ids are hashes of what a document is made of, so stages can be repeated.
Nodes and edges are (id, vec, ...) frames; weights and vectors are doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.functions import text as X
from nodeloom.functions import vectors as V
from nodeloom.functions.embed import embed
from nodeloom.operators import matching as M
from nodeloom.operators import simjoin as S
from nodeloom.options import SEEDS, TIERS, TYPE_SENTENCES, Options
from nodeloom.runtime import Scratch


def made_id(*parts) -> F.Column:
    """Deterministic document id of 24 hexadecimal digits."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24)


# -- leaves ------------------------------------------------------------------------------------------------------------


Types = Callable[[DataFrame], DataFrame]


def leaf_pairs(spark: SparkSession, senses: DataFrame, dim: int, threshold: float, floor: float, recall: float | None = None) -> DataFrame:
    """(a, b, score, q): the greedy pairs of senses (id, word, pos, vec) from ``threshold`` on.

    Pairs of one (word, pos) are raised to ``floor``. recall: see ``simjoin.pairs``; None is exact."""
    p = S.pairs(spark, senses.select("id", "vec"), dim, threshold, recall)
    if floor < threshold:  # raising a pair then changes nothing: it neither lets one in nor changes the order
        return M.greedy_by_score(spark, p, threshold)
    own = S.pairs_within(senses.select("word", "pos", "id", "vec"), ["word", "pos"], dim, -1.0)
    p = p.unionByName(own.select("a", "b", "score")).dropDuplicates(["a", "b"])
    w = senses.select("id", "word", "pos")
    ends = p.join(w.select(F.col("id").alias("a"), F.col("word").alias("wa"), F.col("pos").alias("pa")), "a").join(
        w.select(F.col("id").alias("b"), F.col("word").alias("wb"), F.col("pos").alias("pb")), "b"
    )
    same = (F.col("wa") == F.col("wb")) & (F.col("pa") == F.col("pb"))
    return M.greedy_by_score(spark, ends.select("a", "b", "score", F.coalesce(same, F.lit(False)).alias("same")), threshold, floor)


def leaf_edges(pairs: DataFrame, senses: DataFrame, around: DataFrame | None, type_vectors: Types | None) -> DataFrame:
    """Leaf edges of matched pairs (a, b, q); both ends are members."""
    made = _edges(pairs.select("a", "b", "q"), senses, around, type_vectors, 15)
    return made.withColumn("source", F.lit("inferred")).withColumn("member_ids", F.array("cm1_id", "cm2_id"))


def leaf_reentry(left: DataFrame, edges: DataFrame, around: DataFrame | None, dim: int, type_vectors: Types | None) -> DataFrame:
    """Leaf edges of senses (id, word, pos, vec) without parent to their nearest of ``edges`` (id, vec, q), with its q; only
    the sense gets a parent."""
    near = S.nearest(left.select("id", "vec"), edges.select("id", "vec"), dim)
    e = edges.select(F.col("id").alias("match"), F.col("vec").alias("ve"), F.col("q").alias("q"))
    j = near.join(e, "match").join(left.select("id", "word", "pos", "vec"), "id")
    if type_vectors is None:
        own = j.withColumn("vec", V.neutral_edge_vector(F.col("vec"), F.col("ve"))).withColumn("type_vec", F.lit(None).cast("array<double>"))
    else:
        t = _type_texts(j.select(F.col("id"), F.col("word").alias("wa"), F.col("pos").alias("pa"), F.col("word").alias("wb"), F.lit(None).cast("string").alias("pb")), around)
        own = j.join(type_vectors(t), "id").withColumn("vec", V.edge_vector(F.col("vec"), F.col("ve"), F.col("type_vec"), F.col("q")))
    return own.select(made_id(F.lit("15"), "id", "match").alias("id"), F.col("id").alias("cm1_id"), F.col("match").alias("cm2_id"), F.lit(15).alias("level"), "vec", "type_vec", "q",
                      F.col("q").alias("connection_strength"), F.col("q").alias("accumulated_weight"), F.col("q").alias("confidence"), F.lit("inferred").alias("source"), F.array("id").alias("member_ids"))


def leaf_stage(spark: SparkSession, senses: DataFrame, around: DataFrame | None, dim: int, threshold: float, floor: float,
               type_vectors: Types | None = None, recall: float | None = None) -> DataFrame:
    """Leaf edges of senses (id, word, pos, vec): greedy pairs from ``threshold`` on, then re-entry of the left-over ones.

    around: (word, pos, ant, syn), the words near each word, for the text of an edge's type; type_vectors turns
    (id, type_text) into (id, type_vec), without it edges are type-neutral. ``member_ids``: who gets the edge as parent."""
    w = senses.select("id", "word", "pos", "vec")
    made, _ = Scratch(spark, "leaf").cut(leaf_edges(leaf_pairs(spark, w, dim, threshold, floor, recall), w, around, type_vectors))
    left = w.join(made.select(F.explode("member_ids").alias("id")), "id", "left_anti")
    return made.unionByName(leaf_reentry(left, made, around, dim, type_vectors))


def _type_texts(pairs: DataFrame, around: DataFrame | None) -> DataFrame:
    """(id, type_text) of (id, wa, pa, wb, pb)."""
    none = F.array().cast("array<string>")
    if around is None:
        return pairs.select("id", X.edge_type_text(F.col("wa"), none, none, F.col("wb"), none, none).alias("type_text"))
    a = around.select(F.col("word").alias("wa"), F.col("pos").alias("pa"), F.col("ant").alias("aa"), F.col("syn").alias("sa"))
    b = around.select(F.col("word").alias("wb"), F.col("pos").alias("pb"), F.col("ant").alias("ab"), F.col("syn").alias("sb"))
    j = pairs.join(a, ["wa", "pa"], "left").join(b, ["wb", "pb"], "left")
    args = [F.col("wa"), F.coalesce("aa", none), F.coalesce("sa", none), F.col("wb"), F.coalesce("ab", none), F.coalesce("sb", none)]
    return j.select("id", X.edge_type_text(*args).alias("type_text"))


def _edges(pairs: DataFrame, nodes: DataFrame, around, type_vectors, level: int) -> DataFrame:
    """Edge rows of (a, b, q) between nodes (id, word, pos, vec)."""
    n = nodes.select("id", "word", "pos", "vec")
    j = pairs.join(n.select(F.col("id").alias("a"), F.col("word").alias("wa"), F.col("pos").alias("pa"), F.col("vec").alias("va")), "a")
    j = j.join(n.select(F.col("id").alias("b"), F.col("word").alias("wb"), F.col("pos").alias("pb"), F.col("vec").alias("vb")), "b")
    j = j.withColumn("id", made_id(F.lit(str(level)), "a", "b"))
    if type_vectors is None:
        j = j.withColumn("type_vec", F.lit(None).cast("array<double>")).withColumn("vec", V.neutral_edge_vector(F.col("va"), F.col("vb")))
    else:
        t = type_vectors(_type_texts(j.select("id", "wa", "pa", "wb", "pb"), around))
        j = j.join(t, "id").withColumn("vec", V.edge_vector(F.col("va"), F.col("vb"), F.col("type_vec"), F.col("q")))
    return j.select("id", F.col("a").alias("cm1_id"), F.col("b").alias("cm2_id"), F.lit(level).alias("level"), "vec", "type_vec", "q",
                    F.col("q").alias("connection_strength"), F.col("q").alias("accumulated_weight"), F.col("q").alias("confidence"))


def embedded_types(options: Options) -> Callable[[DataFrame], DataFrame]:
    """(id, type_text) -> (id, type_vec), each different text embedded once."""

    def run(t: DataFrame) -> DataFrame:
        d = t.select("type_text").distinct().withColumn("type_vec", V.doubles(embed(F.col("type_text"), options)))
        return t.join(d, "type_text").select("id", "type_vec")

    return run


# -- words -------------------------------------------------------------------------------------------------------------


def word_constituents(words: DataFrame, senses: DataFrame, edges: DataFrame) -> DataFrame:
    """(word_id, part_id, kind): the different parent edges of a word's senses, and its senses without parent."""
    own = words.select(F.col("id").alias("word_id"), "word", "pos").join(senses.select("word", "pos", F.col("id").alias("sense_id"), "parent_edge_id"), ["word", "pos"])
    has = F.col("parent_edge_id").isNotNull() & (F.col("parent_edge_id") != "")
    e = own.filter(has).select("word_id", F.col("parent_edge_id").alias("part_id")).distinct()
    e = e.join(edges.select(F.col("edge_id").alias("part_id")).distinct(), "part_id", "left_semi").select("word_id", "part_id", F.lit("edge").alias("kind"))
    return e.unionByName(own.filter(~has).select("word_id", F.col("sense_id").alias("part_id"), F.lit("sense").alias("kind")).distinct())


def word_vectors(words: DataFrame, senses: DataFrame, edges: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """(id, vec) of every word with constituents: the normalised sum of their vectors. scope: (id) of words to recompute."""
    if scope is not None:
        words = words.join(scope.select("id"), "id", "left_semi")
    c = word_constituents(words, senses, edges.select(F.col("id").alias("edge_id")))
    v = edges.select(F.col("id").alias("part_id"), V.doubles(F.col("vec")).alias("v")).unionByName(senses.select(F.col("id").alias("part_id"), V.doubles(F.col("vec")).alias("v")))
    g = c.join(v, "part_id").filter("v IS NOT NULL").groupBy(F.col("word_id").alias("id")).agg(V.vector_sum(F.col("v")).alias("s"))
    return g.select("id", V.normalize(F.col("s")).alias("vec"))


def tier_table(spark: SparkSession, seeds: dict[str, float] | None = None) -> DataFrame:
    seeds = seeds or SEEDS
    rows = [(p, e, k, i, float(seeds[s])) for p, e, kinds, s in TIERS for i, k in enumerate(kinds)]
    return spark.createDataFrame(rows, "tier INT, edge_type STRING, kind STRING, kind_at INT, q DOUBLE")


def tier_pairs(spark: SparkSession, resolved: DataFrame, seeds: dict[str, float] | None = None) -> DataFrame:
    """Resolved relations (row_id, kind, a, ord_a, b) as candidates of ``matching.by_tiers``; a kind's relations come in
    stored order, the kinds of a tier in the tier's order."""
    t = resolved.join(F.broadcast(tier_table(spark, seeds)), "kind")  # nine rows
    rel = F.struct("kind_at", "row_id")
    return t.select("tier", "edge_type", "q", "a", "b", "ord_a", rel.alias("ord_rel"))


def type_table(spark: SparkSession, options: Options) -> DataFrame:
    """(edge_type, type_vec): one vector per edge type, embedded once."""
    t = spark.createDataFrame(sorted(TYPE_SENTENCES.items()), "edge_type STRING, sentence STRING")
    return t.select("edge_type", V.doubles(embed(F.col("sentence"), options)).alias("type_vec"))


def word_edges(words: DataFrame, matched: DataFrame, types: DataFrame) -> DataFrame:
    """Word edges of tier matches (a, b, edge_type, q) over words (id, vec); their confidence is 1, as they were given."""
    w = words.filter("vec IS NOT NULL").select("id", "vec")
    m = matched.select("a", "b", "edge_type", "q").join(F.broadcast(types), "edge_type")  # five rows
    m = m.join(w.select(F.col("id").alias("a"), F.col("vec").alias("va")), "a").join(w.select(F.col("id").alias("b"), F.col("vec").alias("vb")), "b")
    return m.select(made_id(F.lit("14"), "a", "b").alias("id"), F.col("a").alias("cm1_id"), F.col("b").alias("cm2_id"), F.lit(14).alias("level"),
                    V.edge_vector(F.col("va"), F.col("vb"), F.col("type_vec"), F.col("q")).alias("vec"), "type_vec", "edge_type", "q",
                    F.col("q").alias("connection_strength"), F.col("q").alias("accumulated_weight"), F.lit(1.0).alias("confidence"),
                    F.lit("ingested").alias("source"), F.array("a", "b").alias("member_ids"))


def word_reentry(left: DataFrame, edges: DataFrame, dim: int) -> DataFrame:
    """Word edges of words (id, vec) without parent to their nearest word edge, whose type, type vector, q and weight they
    inherit; the confidence is q."""
    near = S.nearest(left.select("id", "vec"), edges.select("id", "vec"), dim)
    e = edges.select(F.col("id").alias("match"), F.col("vec").alias("ve"), "type_vec", "edge_type", "q", "accumulated_weight")
    j = near.join(e, "match").join(left.select("id", "vec"), "id")
    return j.select(made_id(F.lit("14"), "id", "match").alias("id"), F.col("id").alias("cm1_id"), F.col("match").alias("cm2_id"), F.lit(14).alias("level"),
                    V.edge_vector(F.col("vec"), F.col("ve"), F.col("type_vec"), F.col("q")).alias("vec"), "type_vec", "edge_type", "q",
                    F.col("q").alias("connection_strength"), "accumulated_weight", F.col("q").alias("confidence"), F.lit("inferred").alias("source"), F.array("id").alias("member_ids"))


def word_stage(spark: SparkSession, words: DataFrame, matched: DataFrame, types: DataFrame, dim: int) -> DataFrame:
    """Word edges of tier matches, and re-entry of the left-over words."""
    made, _ = Scratch(spark, "word").cut(word_edges(words, matched, types))
    left = words.filter("vec IS NOT NULL").select("id", "vec").join(made.select(F.explode("member_ids").alias("id")), "id", "left_anti")
    return made.unionByName(word_reentry(left, made, dim))


# -- triads ------------------------------------------------------------------------------------------------------------


def form_level(spark: SparkSession, children: DataFrame, bridges: DataFrame, child_level: int, threshold: float, dim: int,
               alpha: float = 0.5, candidates: int = 50, recall: float | None = None) -> DataFrame:
    """Triads over children and bridges (id, vec, w) without parents: greedy pairs of children, each with its best bridge
    not taken by an earlier pair. Gives level ``child_level - 2`` documents with their member ids."""
    s = Scratch(spark, "triads")
    p = S.pairs(spark, children.select("id", "vec"), dim, threshold, recall)
    won = M.greedy_by_score(spark, p, threshold)
    c = children.select("id", "vec", "w")
    pairs = won.join(c.select(F.col("id").alias("a"), F.col("vec").alias("va"), F.col("w").alias("wa")), "a").join(c.select(F.col("id").alias("b"), F.col("vec").alias("vb"), F.col("w").alias("wb")), "b")
    pairs = pairs.withColumn("pair", F.concat_ws("|", "a", "b")).withColumn("centroid", V.neutral_edge_vector(F.col("va"), F.col("vb")))
    pairs = M.ranked(pairs, -F.col("score"), F.col("a"), F.col("b"))
    pairs, _ = s.cut(pairs)
    b = bridges.select("id", "vec", "w")
    n = b.count()
    if not n:
        given = spark.createDataFrame([], "pair STRING, bridge STRING, score DOUBLE")
    else:

        def nearest(ps: DataFrame, k: int) -> DataFrame:
            got = S.nearest(ps.select(F.col("pair").alias("id"), F.col("centroid").alias("vec")), b.select("id", "vec"), dim, k)
            return got.select(F.col("id").alias("pair"), F.col("match").alias("bridge"), "score", F.col("rank").alias("pref"))

        given = M.assign_bridges(spark, pairs.select("pair", "rank", "centroid"), nearest, n, candidates)
    j = given.select("pair", "bridge").join(pairs, "pair").join(b.select(F.col("id").alias("bridge"), F.col("vec").alias("vbr"), F.col("w").alias("wbr")), "bridge")
    level = child_level - 2
    w = [F.col("wa"), F.col("wb"), F.col("wbr")]
    return j.select(made_id(F.lit(str(level)), "a", "b", "bridge").alias("id"), F.col("a").alias("cm1_id"), F.col("b").alias("cm2_id"), F.col("bridge").alias("bridge_id"),
                    F.lit(level).alias("level"), V.triad_vector(F.col("va"), F.col("vb"), F.col("vbr"), *w).alias("vec"), F.col("score").alias("child_cosine"),
                    V.raw_weight(*w).alias("connection_strength"), V.accumulated_weight(*w, F.lit(level), alpha).alias("accumulated_weight"), F.array("a", "b", "bridge").alias("member_ids"))


def _free(docs: DataFrame, gone: DataFrame | None, level: int) -> DataFrame:
    d = docs.filter(F.col("level") == level)
    return d if gone is None else d.join(gone, "id", "left_anti")


def _add_level(docs: DataFrame, gone: DataFrame | None, made: DataFrame) -> tuple[DataFrame, DataFrame]:
    new = made.select("id", "vec", F.col("accumulated_weight").alias("w"), "level")
    used = made.select(F.explode("member_ids").alias("id"))
    return docs.select("id", "vec", "w", "level").unionByName(new), used if gone is None else gone.unionByName(used)


def build_levels(spark: SparkSession, edges: DataFrame, dim: int, threshold: float = 0.90, top: int = 15, gone: DataFrame | None = None, **how) -> DataFrame:
    """All triads over edges (id, vec, w, level) without parents: level by level from ``top`` down, children at L, bridges
    at L - 1, triads at L - 2, until a level gives none or L - 2 would be below 1."""
    s = Scratch(spark, "levels")
    docs, out, level = edges.select("id", "vec", "w", "level"), None, top
    while level - 2 >= 1:
        made, c = s.cut(form_level(spark, _free(docs, gone, level), _free(docs, gone, level - 1), level, threshold, dim, **how), n=F.count(F.lit(1)))
        if not c["n"]:
            break
        out = made if out is None else out.unionByName(made)
        docs, gone = _add_level(docs, gone, made)
        level -= 1
    return out if out is not None else made


def sweep(spark: SparkSession, docs: DataFrame, dim: int, base: float = 0.90, floor: Callable[[int], float] | None = None, top: int = 15, gone: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Relaxed triads until a pass adds none: per level the floor round(0.9 - 0.01 level, 2); a level that gives none ends
    the pass, as levels below would need its triads. gone: (id) of documents that have a parent already. Gives (triads, histogram of child cosines per hundredth)."""
    from nodeloom.operators.relational import threshold_histogram

    floor = floor or (lambda level: round(0.9 - 0.01 * level, 2))
    s = Scratch(spark, "sweep")
    docs, out = docs.select("id", "vec", "w", "level"), None
    while True:
        level, added = top, 0
        while level - 2 >= 1:
            if not _free(docs, gone, level).limit(1).count():
                if level == top and not added:
                    level -= 1
                    top = level
                    continue
                break
            made, c = s.cut(form_level(spark, _free(docs, gone, level), _free(docs, gone, level - 1), level, min(base, floor(level)), dim), n=F.count(F.lit(1)))
            out = made if out is None else out.unionByName(made)
            if not c["n"]:
                break
            docs, gone = _add_level(docs, gone, made)
            added += c["n"]
            level -= 1
        if not added:
            break
    if out is None:
        out = form_level(spark, docs.limit(0), docs.limit(0), 15, base, dim)
    return out, threshold_histogram(out.select(F.col("child_cosine").alias("score")), base, 0.0)


# -- everything --------------------------------------------------------------------------------------------------------


def node_frames(words: DataFrame, senses: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """Word and sense nodes of parsed frames; senses without vector are embedded."""
    s = senses.withColumn("vec", V.doubles(F.col("vector")) if "vector" in senses.columns else V.doubles(embed(F.col("embed_text"), options)))
    s = s.withColumn("id", made_id(F.lit("sense"), "sense_id")).withColumn("parent_edge_id", F.lit(None).cast("string"))
    w = words.withColumn("id", made_id(F.lit("word"), "word", "pos")).withColumn("surface", X.surface(F.col("sense_ids")))
    return w, s


def resolve_targets(words: DataFrame, relations: DataFrame) -> DataFrame:
    """(row_id, kind, a, ord_a, b) of relations (row_id, word, pos, kind, target) between words (id, word, pos, ord): the word
    of the same part of speech first, else the first of that spelling, else none."""
    first = words.groupBy(F.col("word").alias("target")).agg(F.min(F.struct("ord", "id")).alias("f")).select("target", F.col("f.id").alias("first"))
    r = relations.join(words.select("word", "pos", F.col("id").alias("a"), F.col("ord").alias("ord_a")), ["word", "pos"])
    r = r.join(words.select(F.col("word").alias("target"), "pos", F.col("id").alias("exact")), ["target", "pos"], "left").join(first, "target", "left")
    return r.select("row_id", "kind", "a", "ord_a", F.coalesce("exact", "first").alias("b")).filter("b IS NOT NULL")


def build_graph(spark: SparkSession, words: DataFrame, senses: DataFrame, relations: DataFrame, options: Options) -> dict[str, DataFrame]:
    """The whole graph of parsed words (word, pos, sense_ids, ord), senses (sense_id, word, pos, embed_text[, vector]) and
    word relations (row_id, word, pos, kind, target): frames words, senses, leaf_edges, word_edges, triads, provenance."""
    from nodeloom.operators import provenance as P
    from nodeloom.plans.catalog import neighbourhoods

    o, s = options, Scratch(spark, "graph")
    w, n = node_frames(words, senses, o)
    n, _ = s.cut(n)
    around = neighbourhoods(relations.select("row_id", F.col("word").alias("from_word"), F.col("pos").alias("from_pos"), "kind", F.col("target").alias("word")))
    leaf, _ = s.cut(leaf_stage(spark, n.select("id", "word", "pos", "vec"), around, o.dim, o.q_min_leaf, o.polysemy_floor, embedded_types(o), o.pair_recall or None))
    members = leaf.select(F.col("id").alias("parent"), F.explode("member_ids").alias("id"))
    n = n.drop("parent_edge_id").join(members.withColumnRenamed("parent", "parent_edge_id"), "id", "left")
    v, _ = s.cut(word_vectors(w, n, leaf))
    w = w.join(v, "id", "left")
    r = resolve_targets(w, relations)
    matched = M.by_tiers(spark, tier_pairs(spark, r, o.seeds))
    we, _ = s.cut(word_stage(spark, w.select("id", "vec"), matched, type_table(spark, o), o.dim))
    e = leaf.select("id", "vec", F.col("accumulated_weight").alias("w"), "level").unionByName(we.select("id", "vec", F.col("accumulated_weight").alias("w"), "level"))
    triads = build_levels(spark, e, o.dim, o.triad_cosine, alpha=o.level_alpha, candidates=o.bridge_candidates, recall=o.pair_recall or None)
    prov = P.register(None, n, "id", "doi") if "doi" in n.columns else None
    if prov is not None:
        for made in (leaf, we, triads):
            prov = P.propagate(prov, made.select(F.col("id").alias("new_id"), F.explode(F.array("cm1_id", "cm2_id")).alias("part_id")))
    return {"words": w, "senses": n, "leaf_edges": leaf, "word_edges": we, "triads": triads} | ({"provenance": prov} if prov is not None else {})
