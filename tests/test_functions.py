import math

import numpy as np
from pyspark.sql import functions as F

from nodeloom.functions import text as X
from nodeloom.functions import vectors as V
from nodeloom.functions.embed import embed, fake_vector
from nodeloom.functions.visual import visual_form
from nodeloom.options import TIERS, Options


def arr(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_algebra(spark):
    r = one(spark, V.normalize(arr(3, 4)), V.normalize(arr(0, 0)), V.cosine(arr(1, 0), arr(0, 2)), V.edge_vector(arr(1, 0), arr(0, 1), arr(5, 5), F.lit(1.0)),
            V.edge_vector(arr(1, 0), arr(0, 1), arr(0, 3), F.lit(0.0)), V.raw_weight(F.lit(0.3), F.lit(0.4), F.lit(0.5)), V.raw_weight(F.lit(0.0), F.lit(0.0), F.lit(0.0)),
            V.level_factor(F.lit(13)), V.level_factor(F.lit(1)), V.threshold_floor(F.lit(15)), V.triad_vector(arr(1, 0), arr(0, 1), arr(1, 1), F.lit(1.0), F.lit(1.0), F.lit(2.0)), V.cosine(arr(0, 0), arr(1, 1)), V.normalize(F.lit(None).cast("array<double>")))
    assert r[0] == [0.6, 0.8] and r[1] == [0.0, 0.0] and r[2] == 0
    assert np.allclose(r[3], [math.sqrt(0.5)] * 2) and np.allclose(r[4], [0, 1])
    assert math.isclose(r[5], 0.25 / math.sqrt(0.3**4 + 0.4**4 + 0.5**4)) and r[6] == 0
    assert math.isclose(r[7], 1 + 0.5 / 13) and r[8] == 1.5 and r[9] == 0.75
    assert np.allclose(r[10], [math.sqrt(0.5)] * 2) and r[11] == 0 and r[12] is None


def test_vector_aggregates(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 6.0])], "k INT, v ARRAY<DOUBLE>")
    g = {r.k: (r.s, r.m) for r in d.groupBy("k").agg(V.vector_sum(F.col("v")).alias("s"), V.vector_mean(F.col("v")).alias("m")).collect()}
    assert g == {1: ([4.0, 6.0], [2.0, 3.0]), 2: ([5.0, 6.0], [5.0, 6.0])}


def test_text_functions(spark):
    s = lambda x: F.lit(x)
    ex = F.array(s("e1"), s("e2"), s("e3"))
    r = one(spark, X.embed_text(s("G"), ex), X.sense_id(s(""), s("foo"), s("noun"), F.lit(0)), X.term_sense_id(s(None).cast("string"), s("t1"), s("gloss")),
            X.term_sense_id(s("10.1/x"), s("t1"), s("gloss")), X.normalize_term(s("  two \t words ")), X.normalize_doi(s(" (No DOI) ")), X.normalize_doi(s(" 10.1/x ")),
            X.parse_weights(s("80 x 20")), X.argmax_weight(F.array(F.lit(0), F.lit(7), F.lit(7))), X.argmax_weight(F.array(F.lit(0), F.lit(0))),
            X.edge_type_text(s("a"), F.array(s("b")), F.array(s("c"), s("d")), s("e"), F.array().cast("array<string>"), F.array().cast("array<string>")),
            X.semantic_label(s('{"semantic_label": "warm light"}')), X.semantic_label(s('{"semantic_label": "x"}')), X.parse_weights(s(None).cast("string")),
            X.resolve_sense(F.array(F.lit(0)), F.lit(2), F.lit(0.8)), X.resolve_sense(F.array(F.lit(0)), F.lit(2), F.lit(0.7)))
    assert r[0] == "G e1 e2" and r[1] == "foo-noun-0" and r[2].startswith("batch:nodoi:t1:") and len(r[2].split(":")[3]) == 10 and r[3] == "batch:10.1/x:t1"
    assert r[4] == "two words" and r[5] is None and r[6] == "10.1/x" and r[7] == [80, 0, 20] and r[8] == 1 and r[9] is None
    assert r[10] == "a (antonyms: b; synonyms: c, d); e" and r[11] == "warm light" and r[12] is None and r[13] == [] and r[14] == 2 and r[15] is None


def test_visual_form(spark):
    cases = [("ｈｅａｔ", "heat"), ("Thе", "The"), ("éţ", "éţ"), ("wa​ter︎", "water"), ("a b‐c", "a b-c"), ("ﬂag ﬆone", "flag stone"), ("жук", "жук"),
             ("λόγος", "λόγος"), ("νο", "vo"), ("сlоtһ жар", "cloth жар"), (None, None), ("", ""), ("​⁠", ""), ("À ËÏ", "À ËÏ"), ("x" * 50_000 + "​", "x" * 50_000), ("Ḯ", "Ḯ")]
    d = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i INT, v STRING")
    got = [r.f for r in d.select("i", visual_form(F.col("v")).alias("f")).orderBy("i").collect()]
    assert got == [b for _, b in cases]
    ipa = [("/'mobi:s/", "/ˈmobiːs/"), ("ɡgǝɩαε", "ɡɡəɪɑɛ"), ("d͡ʒɛ̃β θχ", "d͡ʒɛ̃β θχ"), ("／ａ．ｂ／", "/a.b/"), ("tʰ", "tʰ")]
    d = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(ipa)], "i INT, v STRING")
    assert [r.f for r in d.select("i", visual_form(F.col("v"), "ipa").alias("f")).orderBy("i").collect()] == [b for _, b in ipa]


def test_embed_and_options(spark):
    o = Options(dim=8)
    d = spark.createDataFrame([("a",), (None,), ("a",)], "t STRING").select(embed(F.col("t"), o).alias("v")).collect()
    assert np.allclose(d[0].v, fake_vector("a", 8)) and d[1].v is None and d[0].v == d[2].v and math.isclose(np.linalg.norm(d[0].v), 1, rel_tol=1e-6)
    o = Options.load({"NODELOOM_DIM": "12", "NODELOOM_Q_SEED_EXTENDS": "0.5", "NODELOOM_FAKE_EMBEDDER": "no"})
    assert o.dim == 12 and o.seeds["extends"] == 0.5 and not o.fake_embedder and Options().q_min_leaf == 0.72 and len(TIERS) == 6
