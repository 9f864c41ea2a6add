"""Closures over a graph of nodes and edges: down to leaves, up to ancestors, triad views, lookups.

The graph is one table of documents (id, doc_type, node_type, level, word, pos, sense_id, cm1_id, cm2_id, bridge_id,
parent_edge_id, ...). Walks go ``HOPS`` steps a round for all starts at once: the pointers of the graph are composed with
themselves by doubling, then each round joins the ids that are a multiple of ``HOPS`` steps away with that table. A
shortest way to any id passes one of those at every multiple, so the least depth of each (start, id) comes out. Up to
``FEW_STARTS`` starts of a short walk go single steps instead, as composing the whole graph would cost more. Every round is cut by a
written table.

Defined results: starts that are no documents give no rows; null, empty and unknown pointers end a walk; a node is its
own only leaf; loops end, as no id is visited twice for one start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from nodeloom.runtime import Scratch

DEPTH, HOPS, FEW_STARTS = 15, 4, 2000


def latest(docs: DataFrame, key: str = "id", at: str = "updated_at") -> DataFrame:
    """The latest state of each document; rows without id are none."""
    rest = [c for c in docs.columns if c not in (key, at)]
    d = docs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(at, *rest)).alias("_s"))
    return d.select(key, *[F.col(f"_s.{c}").alias(c) for c in docs.columns if c != key]).select(*docs.columns)


def _children(graph: DataFrame) -> DataFrame:
    e = graph.filter("doc_type <> 'node'").select(F.col("id").alias("_p"), F.explode(F.array("cm1_id", "cm2_id")).alias("_c"))
    return e.filter(F.col("_c").isNotNull() & (F.col("_c") != ""))


def _reach(s: Scratch, links: DataFrame, starts: DataFrame, keys: list[str], most: int, max_depth: int | None) -> DataFrame:
    """The walk of ``starts`` (keys, id) over links (_p, _c), by steps or by composed pointers as their number asks for."""
    first, c = s.cut(starts.select(*keys, "id").distinct(), n=F.count(F.lit(1)))
    most = 1 if c["n"] <= FEW_STARTS and max_depth is not None and max_depth <= DEPTH else most
    return _walk(s, first, keys, _hops(s, links, most), most, max_depth)


def _hops(s: Scratch, links: DataFrame, most: int) -> DataFrame:
    """(_p, _c, _d): all ids within ``most`` (a power of two) steps over links (_p, _c), with the least number of steps."""
    h, _ = s.cut(links.select("_p", "_c").distinct().withColumn("_d", F.lit(1)))
    step = 1
    while step < most:
        left = h.select("_p", F.col("_c").alias("_m"), F.col("_d").alias("_a"))
        right = h.select(F.col("_p").alias("_m"), "_c", F.col("_d").alias("_b"))
        two = left.join(right, "_m").select("_p", "_c", (F.col("_a") + F.col("_b")).alias("_d"))
        nxt, _ = s.cut(h.unionByName(two).groupBy("_p", "_c").agg(F.min("_d").alias("_d")))
        s.drop(h)
        h, step = nxt, step * 2
    return h


def _walk(s: Scratch, front: DataFrame, keys: list[str], hops: DataFrame, per: int, max_depth: int | None) -> DataFrame:
    """(keys, id, depth) of everything within ``max_depth`` steps of ``front`` (keys, id), least depth each; None: of everything."""
    most = float("inf") if max_depth is None else max_depth
    front, c = s.cut(front.select(*keys, "id", F.lit(0).alias("depth")).distinct(), n=F.count(F.lit(1)))
    seen, at = front, 0
    while c["n"] and at < most:
        new = front.join(hops, front.id == hops["_p"]).select(*keys, F.col("_c").alias("id"), (F.col("depth") + F.col("_d")).alias("depth"))
        new = new.filter(F.col("depth") <= F.lit(most)).groupBy(*keys, "id").agg(F.min("depth").alias("depth"))
        at += per
        new, c = s.cut(new, n=F.count(F.when(F.col("depth") == at, 1)))
        front = new.filter(F.col("depth") == at)
        if c["n"] and at < most:
            front, c = s.cut(front.join(seen.select(*keys, "id"), [*keys, "id"], "left_anti"), n=F.count(F.lit(1)))
        seen = seen.unionByName(new)
    return seen.groupBy(*keys, "id").agg(F.min("depth").alias("depth"))


def down_closure(spark: SparkSession, graph: DataFrame, starts: DataFrame, max_depth: int = DEPTH) -> DataFrame:
    """(start, id, depth) of every document reached from (start, id) over child pointers, the first step at depth 0.

    Bridges are not followed. ``start`` may be several columns: all but ``id`` are carried along."""
    s = Scratch(spark, "down")
    keys = [c for c in starts.columns if c != "id"]
    known = graph.select("id")
    links = _children(graph).join(known.select(F.col("id").alias("_c")), "_c", "left_semi")
    return _reach(s, links, starts.join(known, "id", "left_semi"), keys, HOPS, max_depth)


def leaf_documents(spark: SparkSession, graph: DataFrame, starts: DataFrame, max_depth: int = DEPTH) -> DataFrame:
    """The nodes below each start, with their word, part of speech, kind and sense."""
    c = down_closure(spark, graph, starts, max_depth)
    n = graph.filter("doc_type = 'node'").select("id", "node_type", "word", "pos", "sense_id", "label")
    return c.join(n, "id")


def leaf_words(spark: SparkSession, graph: DataFrame, starts: DataFrame, cap: int | None = None, max_depth: int = DEPTH) -> DataFrame:
    """(start, words, truncated): sorted different words of the leaves; with ``cap`` the first so many. The flag says that
    there are more words, or documents with children at the end of the walk."""
    keys = [c for c in starts.columns if c != "id"]
    c = down_closure(spark, graph, starts, max_depth)
    n = graph.filter("doc_type = 'node' AND word IS NOT NULL").select("id", "word")
    l = c.join(n, "id").select(*keys, "word").distinct()
    if cap is not None:
        l = l.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy("word"))).filter(F.col("_r") <= cap + 1)
    w = l.groupBy(*keys).agg(F.array_sort(F.collect_list("word")).alias("words"))
    deep = c.filter(F.col("depth") == max_depth).join(_children(graph).select(F.col("_p").alias("id")), "id", "left_semi").select(*keys).distinct().withColumn("_deep", F.lit(True))
    w = w.join(deep, keys, "left").withColumn("_deep", F.coalesce("_deep", F.lit(False)))
    if cap is None:
        return w.select(*keys, "words", F.col("_deep").alias("truncated"))
    return w.select(*keys, F.slice("words", 1, cap).alias("words"), ((F.size("words") > cap) | F.col("_deep")).alias("truncated"))


def word_overlaps(spark: SparkSession, graph: DataFrame, pairs: DataFrame, max_depth: int = DEPTH) -> DataFrame:
    """(id, overlap, jaccard) of the leaf words below the two documents of each (id, a, b), by counts of joined words; a
    document without leaf words is in no result."""
    ends = pairs.select(F.col("a").alias("start")).unionByName(pairs.select(F.col("b").alias("start"))).filter("start IS NOT NULL").distinct()
    l = leaf_documents(spark, graph, ends.select("start", F.col("start").alias("id")), max_depth).filter(F.col("word").isNotNull()).select("start", "word").distinct()
    l, _ = Scratch(spark, "overlap").cut(l)
    n = l.groupBy("start").agg(F.count(F.lit(1)).alias("n"))
    p = pairs.join(n.select(F.col("start").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("start").alias("b"), F.col("n").alias("nb")), "b")
    both = pairs.join(l.withColumnRenamed("start", "a"), "a").join(l.withColumnRenamed("start", "b"), ["b", "word"]).groupBy("id").agg(F.count(F.lit(1)).alias("overlap"))
    r = p.join(both, "id", "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    return r.select("id", "overlap", (F.col("overlap") / (F.col("na") + F.col("nb") - F.col("overlap"))).alias("jaccard"))


def any_leaf_has_word(spark: SparkSession, graph: DataFrame, targets: DataFrame, max_depth: int = DEPTH) -> DataFrame:
    """(start, target) rows of (start, id, target) for which some leaf below id has the target word."""
    l = leaf_documents(spark, graph, targets.select("start", "id"), max_depth).select("start", "word").distinct()
    t = targets.select("start", "target").distinct()
    return t.join(l, (t.start == l.start) & (t.target == l.word), "left_semi")


def bridges(graph: DataFrame) -> DataFrame:
    """(id, bridge): the stored bridge of each triad, else the smallest document whose parent is the triad and that is
    neither of its children."""
    e = graph.filter("doc_type <> 'node' AND level <= 13").select("id", "cm1_id", "cm2_id", F.when(F.col("bridge_id") != "", F.col("bridge_id")).alias("given"))
    kid = graph.select(F.col("id").alias("_b"), F.col("parent_edge_id").alias("_p"))
    near = e.join(kid, F.col("_p") == F.col("id"), "left").withColumn("_b", F.when(~F.col("_b").eqNullSafe(F.col("cm1_id")) & ~F.col("_b").eqNullSafe(F.col("cm2_id")), F.col("_b")))
    return near.groupBy("id").agg(F.first("given").alias("given"), F.min("_b").alias("found")).select("id", F.coalesce("given", "found").alias("bridge"))


def triad_view(spark: SparkSession, graph: DataFrame, ids: DataFrame, max_depth: int = DEPTH, cap: int | None = None) -> DataFrame:
    """(id, branch, words): sorted different leaf words (the first ``cap`` of them) of the two children and the bridge of
    each triad, in one walk."""
    t = graph.join(ids.select("id"), "id", "left_semi").filter("doc_type <> 'node' AND level <= 13")
    b = t.join(bridges(graph).join(ids.select("id"), "id", "left_semi"), "id", "left")
    starts = b.select(F.col("id").alias("start"), F.explode(F.array(
        F.struct(F.lit("child1").alias("branch"), F.col("cm1_id").alias("id")),
        F.struct(F.lit("child2").alias("branch"), F.col("cm2_id").alias("id")),
        F.struct(F.lit("bridge").alias("branch"), F.col("bridge").alias("id")),
    )).alias("x")).select("start", "x.branch", "x.id").filter(F.col("id").isNotNull())
    w = leaf_words(spark, graph, starts, cap, max_depth)
    return w.select(F.col("start").alias("id"), "branch", "words")


def _parents(graph: DataFrame) -> DataFrame:
    up = graph.filter(F.col("parent_edge_id").isNotNull() & (F.col("parent_edge_id") != "")).select(F.col("id").alias("_p"), F.col("parent_edge_id").alias("_c"))
    return up.join(graph.select(F.col("id").alias("_c")), "_c", "left_semi")


def ancestors(spark: SparkSession, graph: DataFrame, starts: DataFrame, max_levels: int | None = 6) -> DataFrame:
    """(start, step, id): the chain of parents of each start, step 1 the parent; ends at loops, roots and, unless it is
    None, ``max_levels``."""
    s = Scratch(spark, "up")
    got = _reach(s, _parents(graph), starts.select(F.col("id").alias("start"), "id"), ["start"], 2 * HOPS, max_levels)
    return got.filter("depth > 0").select("start", F.col("depth").alias("step"), "id")


def ancestor_chains(spark: SparkSession, graph: DataFrame, hits: DataFrame, max_levels: int = 20) -> DataFrame:
    """(hit, step, id, pointer) of (hit, id): an ancestor met before, in order of hit and step, is a pointer and ends
    its chain; documents that are hits themselves count as met, and so does the one a chain comes back to in a loop.

    Steps beyond a pointer meet nothing. Which steps those are depends on the hits before: rounds take the first hit that
    walks over each ancestor and cut the chains there until nothing changes, which is the walk of one hit after another."""
    s = Scratch(spark, "chains")
    starts = hits.select("id").distinct()
    a, _ = s.cut(ancestors(spark, graph, starts, max_levels))
    ends = a.unionByName(starts.select(F.col("id").alias("start"), F.lit(0).alias("step"), "id")).groupBy("start").agg(F.max(F.struct("step", "id")).alias("e"))
    loop = ends.join(_parents(graph), F.col("e.id") == F.col("_p")).filter(F.col("e.step") < max_levels).select("start", (F.col("e.step") + 1).alias("step"), F.col("_c").alias("id"))
    a = a.withColumn("loop", F.lit(False)).unionByName(loop.withColumn("loop", F.lit(True)))
    a = hits.select("hit", F.col("id").alias("start")).join(a, "start")
    own = starts.select(F.col("id").alias("_h"))
    a = a.join(own, a.id == F.col("_h"), "left").select("hit", "step", "id", (F.col("loop") | F.col("_h").isNotNull()).alias("met"))
    own_stop = F.min(F.when(F.col("met"), F.col("step"))).over(W.partitionBy("hit"))
    a = a.withColumn("stop", own_stop).filter(F.col("stop").isNull() | (F.col("step") <= F.col("stop")))
    a, c = s.cut(a.select("hit", "step", "id", "met", F.col("met").alias("pointer"), "stop", (~F.col("met")).alias("walked")), n=F.count(F.lit(1)))
    while c["n"]:
        first = a.filter("walked").groupBy("id").agg(F.min("hit").alias("first"))
        nxt = a.select("hit", "step", "id", "met", F.col("walked").alias("was")).join(first, "id", "left")
        nxt = nxt.withColumn("pointer", F.col("met") | F.coalesce(F.col("first") < F.col("hit"), F.lit(False)))
        nxt = nxt.withColumn("stop", F.min(F.when(F.col("pointer"), F.col("step"))).over(W.partitionBy("hit")))
        nxt = nxt.withColumn("walked", F.col("stop").isNull() | (F.col("step") < F.col("stop")))
        nxt, c = s.cut(nxt.select("hit", "step", "id", "met", "pointer", "stop", "walked", "was"), n=F.count(F.when(F.col("walked") != F.col("was"), 1)))
        s.drop(a)
        a = nxt
    return a.filter(F.col("stop").isNull() | (F.col("step") <= F.col("stop"))).select("hit", "step", "id", "pointer")


def edges_of_words(graph: DataFrame, words: DataFrame) -> DataFrame:
    """(word_id, edge_id, partner_id, partner_label): the word-level edges at each (word_id) node, by two equi-joins.

    A partner that is an edge is labelled by its document type."""
    e = graph.filter("doc_type <> 'node' AND level = 14").select(F.col("id").alias("edge_id"), "cm1_id", "cm2_id", "edge_type", "q")
    a = words.join(e, words.word_id == e.cm1_id).select("word_id", "edge_id", F.col("cm2_id").alias("partner_id"), "edge_type", "q")
    b = words.join(e, (words.word_id == e.cm2_id) & ~e.cm2_id.eqNullSafe(e.cm1_id)).select("word_id", "edge_id", F.col("cm1_id").alias("partner_id"), "edge_type", "q")
    lab = graph.select(F.col("id").alias("partner_id"), F.when(F.col("doc_type") == "node", F.col("label")).otherwise(F.col("doc_type")).alias("partner_label"))
    return a.unionByName(b).join(lab, "partner_id", "left").select("word_id", "edge_id", "edge_type", "q", "partner_id", "partner_label")


def word_degrees(graph: DataFrame, words: DataFrame) -> DataFrame:
    """(word_id, degree): how many word-level edges name each node; 0 for none."""
    e = graph.filter("doc_type <> 'node' AND level = 14").select(F.explode(F.array("cm1_id", "cm2_id")).alias("word_id"))
    d = e.join(words.select("word_id"), "word_id", "left_semi").groupBy("word_id").agg(F.count(F.lit(1)).alias("degree"))
    return words.select("word_id").distinct().join(d, "word_id", "left").fillna({"degree": 0})
