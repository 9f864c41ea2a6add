from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from nodeloom.operators import graph as G
from nodeloom.operators import provenance as P
from nodeloom.operators import relational as R

COLS = "id STRING, doc_type STRING, node_type STRING, level INT, label STRING, parent_edge_id STRING, cm1_id STRING, cm2_id STRING, bridge_id STRING, edge_type STRING, q DOUBLE, connection_strength DOUBLE, accumulated_weight DOUBLE, source STRING, confidence DOUBLE, word STRING, pos STRING, sense_id STRING, created_at TIMESTAMP, updated_at TIMESTAMP"


def node(i, word, parent=None, kind="sense", level=15):
    return (i, "node", kind, level, f"{word} (n)", parent, None, None, None, None, None, None, None, None, None, word, "n", f"{i}-s", dt(2024, 1, 1), dt(2024, 1, 1))


def edge(i, level, a, b, parent=None, bridge=None):
    return (i, "edge", None, level, None, parent, a, b, bridge, "extends" if level == 14 else None, 0.5, 0.5, 0.5, "inferred", 0.5, None, None, None, dt(2024, 1, 1), dt(2024, 1, 1))


@pytest.fixture(scope="module")
def graph(spark):
    rows = [node("n1", "sun", "e1"), node("n2", "day", "e1"), node("n3", "moon", "e2"), node("n4", "night", "e2"), node("w1", "sun", "f1", "word", 14), node("w2", "moon", "f1", "word", 14),
            edge("e1", 15, "n1", "n2", "t"), edge("e2", 15, "n3", "n4", "t"), edge("f1", 14, "w1", "w2", "t"), edge("t", 13, "e1", "e2"), edge("r", 15, "n1", "e2"), edge("l1", 12, "l2", "zz"), edge("l2", 12, "l1", "n1", "l1")]
    return spark.createDataFrame(rows, COLS).cache()


def test_down(spark, graph):
    w = {r.start: (r.words, r.truncated) for r in G.leaf_words(spark, graph, graph.select(F.col("id").alias("start"), "id")).collect()}
    assert w["t"][0] == ["day", "moon", "night", "sun"] and w["r"][0] == ["moon", "night", "sun"] and w["l1"][0] == ["sun"] and w["n1"][0] == ["sun"]
    c = G.leaf_words(spark, graph, graph.filter("id = 't'").select(F.col("id").alias("start"), "id"), cap=2).first()
    assert c.words == ["day", "moon"] and c.truncated
    short = {r.start: r.truncated for r in G.leaf_words(spark, graph, graph.filter("id IN ('t', 'e1', 'n1')").select(F.col("id").alias("start"), "id"), max_depth=1).collect()}
    assert short == {"e1": False, "n1": False} and G.leaf_words(spark, graph, graph.filter("id = 'r'").select(F.col("id").alias("start"), "id"), max_depth=1).first().truncated
    o = spark.createDataFrame([("x", "e1", "e2"), ("y", "t", "r"), ("z", "t", None)], "id STRING, a STRING, b STRING")
    assert {r.id: (r.overlap, r.jaccard) for r in G.word_overlaps(spark, graph, o).collect()} == {"x": (0, 0.0), "y": (3, 0.75)}
    t = spark.createDataFrame([("p", "t", "moon"), ("p", "t", "sea"), ("x", "zz", "moon")], "start STRING, id STRING, target STRING")
    assert [tuple(r) for r in G.any_leaf_has_word(spark, graph, t).collect()] == [("p", "moon")]


def test_triads_and_bridges(spark, graph):
    v = {r.branch: r.words for r in G.triad_view(spark, graph, graph.filter("id = 't'")).collect()}
    assert v == {"child1": ["day", "sun"], "child2": ["moon", "night"], "bridge": ["moon", "sun"]}
    assert {r.id: r.bridge for r in G.bridges(graph).collect()}["t"] == "f1"


def test_up(spark, graph):
    assert sorted((r.step, r.id) for r in G.ancestors(spark, graph, graph.filter("id = 'n1'").select("id")).collect()) == [(1, "e1"), (2, "t")]
    hits = spark.createDataFrame([("1", "n1"), ("2", "n3"), ("3", "t")], "hit STRING, id STRING")
    c = sorted((r.hit, r.step, r.id, r.pointer) for r in G.ancestor_chains(spark, graph, hits).collect())
    assert c == [("1", 1, "e1", False), ("1", 2, "t", True), ("2", 1, "e2", False), ("2", 2, "t", True)]


def test_chains_equal_sequential_walk(spark):
    import random

    r = random.Random(5)
    for most in (20, 3):
        up = {f"n{i:03d}": f"n{r.randrange(max(0, i - 6), i):03d}" for i in range(1, 120) if r.random() < 0.93} | {"p": "q", "q": "r", "r": "q", "o": "o", "z": "gone"}
        ids = sorted({*up, "n000"})
        hits = sorted(r.sample(ids[:-5], 45)) + ["p", "o", "z"]
        order = {x: f"{k:03d}" for k, x in enumerate(r.sample(hits, len(hits)))}
        met, exp = set(hits), []
        for x in sorted(hits, key=order.get):
            at = up.get(x)
            for step in range(1, most + 1):
                if at not in ids:
                    break
                exp.append((order[x], step, at, at in met))
                if at in met:
                    break
                met.add(at)
                at = up.get(at)
        g = spark.createDataFrame([node(i, "w", up.get(i)) for i in ids], COLS)
        h = spark.createDataFrame([(order[x], x) for x in hits], "hit STRING, id STRING")
        assert sorted(map(tuple, G.ancestor_chains(spark, g, h, most).collect())) == exp


def test_lookups(graph):
    w = graph.filter("node_type = 'word'").select(F.col("id").alias("word_id"))
    assert sorted((r.word_id, r.partner_id, r.partner_label) for r in G.edges_of_words(graph, w).collect()) == [("w1", "w2", "moon (n)"), ("w2", "w1", "sun (n)")]
    assert {r.word_id: r.degree for r in G.word_degrees(graph, w).collect()} == {"w1": 1, "w2": 1}


def test_provenance(spark, graph):
    s = spark.createDataFrame([("n1", ["d1", " ", None]), ("n3", ["d2"]), ("n4", None)], "id STRING, doi ARRAY<STRING>")
    p = P.register(None, s)
    p = P.propagate(p, spark.createDataFrame([("e1", "n1"), ("e1", "n2")], "new_id STRING, part_id STRING"))
    p = P.propagate_up_chain(spark, p, graph, s)
    assert sorted(map(tuple, p.collect())) == [("d1", "e1"), ("d1", "n1"), ("d1", "t"), ("d2", "e2"), ("d2", "n3"), ("d2", "t")]
    assert {r.id: r.dois for r in P.dois_of(p, graph).collect()}["t"] == ["d1", "d2"]


def test_provenance_reaches_a_far_root(spark):
    g = spark.createDataFrame([node(f"c{i:02d}", "w", f"c{i + 1:02d}" if i < 80 else None) for i in range(81)], COLS)
    s = spark.createDataFrame([("c00", ["d1"])], "id STRING, doi ARRAY<STRING>")
    assert {r.node_id for r in P.propagate_up_chain(spark, P.register(None, s), g, s).collect()} == {f"c{i:02d}" for i in range(81)}


def test_relational(spark, graph):
    d = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "z")], "k STRING, o INT, v STRING")
    assert sorted(map(tuple, R.last_wins(d, ["k"], "o").collect()), key=str) == [("a", 2, None), ("b", 1, "z")]
    u = R.upsert(d.filter("o = 1"), d.filter("o = 2"), ["k"])
    assert {r.k: r.o for r in u.collect()} == {"a": 2, "b": 1}
    s = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (2.0, 5.0), (9.0, 7.0)], "x DOUBLE, y DOUBLE")
    import pandas as pd

    p = s.toPandas()
    assert abs(R.spearman(s, "x", "y").first().rho - pd.Series(p.x).rank().corr(pd.Series(p.y).rank())) < 1e-12
    h = R.threshold_histogram(spark.createDataFrame([(0.95,), (0.91,), (0.855,), (0.1,)], "score DOUBLE"), 0.9, 0.5)
    assert {r.bucket: r.n for r in h.collect()} == {0.9: 2, 0.85: 1}
    g = graph.withColumns({"semantic_label": F.lit(None).cast("string"), "label_vector": F.lit(None).cast("array<double>"), "label_model": F.lit(None).cast("string"), "label_updated_at": F.lit(None).cast("timestamp")})
    l = spark.createDataFrame([("t", "light", [1.0], "m"), ("n1", "no", [1.0], "m"), ("l1", "bad", [1.0, 2.0], "m")], "id STRING, semantic_label STRING, label_vector ARRAY<DOUBLE>, label_model STRING")
    once = R.write_labels(g, l, 1)
    twice = R.write_labels(once, l.withColumn("semantic_label", F.lit("other")), 1)
    assert {r.id: r.semantic_label for r in twice.filter("semantic_label IS NOT NULL").collect()} == {"t": "light"}
    assert {r.id: r.semantic_label for r in R.write_labels(once, l.withColumn("semantic_label", F.lit("other")), 1, guarded=False).filter("semantic_label IS NOT NULL").collect()} == {"t": "other"}
    assert {r.id: r.parent_edge_id for r in R.set_parent(graph, spark.createDataFrame([("t", "zz")], "member_id STRING, parent STRING")).collect()}["t"] == "zz"
