from datetime import datetime as dt

from pyspark.sql import functions as F

from nodeloom.operators.references import Reference, availability, cascade


def refs(spark, rows):
    return spark.createDataFrame(rows, "src_table STRING, row_id BIGINT, own_key STRING, field STRING, item_idx INT, ref_key STRING, at TIMESTAMP")


def test_direct_times(spark):
    a, b = dt(2024, 1, 1), dt(2024, 6, 1)
    keys = spark.createDataFrame([("w", b), ("w", dt(2024, 3, 1)), ("n", None), (None, a)], "key STRING, since TIMESTAMP")
    r = refs(spark, [("t", 1, None, "f", 0, "w", a), ("t", 2, None, "f", 0, "w", dt(2024, 3, 1)), ("t", 3, None, "f", 0, "x", b), ("t", 4, None, "f", 0, "n", a), ("t", 5, None, "f", 0, "w", None), ("t", 6, None, "f", 0, "x", None), ("t", 3, None, "f", 0, "x", b)])
    got = sorted(x.row_id for x in cascade(spark, {"p": keys}, [Reference("t", "p", r)]).collect())
    assert got == [1, 3, 3, 6]
    assert cascade(spark, {"p": keys.limit(0)}, [Reference("t", "p", r)]).count() == 7


def test_cascade_to_fixpoint(spark):
    t = dt(2024, 1, 1)
    p = spark.createDataFrame([("k", t)], "key STRING, since TIMESTAMP")
    s = refs(spark, [("s", 1, "s1", "w", 0, "gone", t), ("s", 2, "s2", "w", 0, "k", t), ("s", 3, "s3", "up", 0, "s1", t), ("s", 4, "s4", "up", 0, "s3", t)])
    own = spark.createDataFrame([(f"s{i}", t) for i in range(1, 5)], "key STRING, since TIMESTAMP")
    leaf = refs(spark, [("r", 1, None, "s", 0, "s4", t), ("r", 2, None, "s", 0, "s2", t), ("r", 3, None, "s", 0, "none", t)])
    got = cascade(spark, {"p": p, "s": own}, [Reference("s", "p", s.filter("field = 'w'")), Reference("s", "s", s.filter("field = 'up'")), Reference("r", "s", leaf)])
    k = {(r.src_table, r.row_id): (r.kind, r["round"]) for r in got.collect()}
    assert k == {("s", 1): ("direct", 0), ("s", 3): ("inherited", 1), ("s", 4): ("inherited", 2), ("r", 1): ("inherited", 3), ("r", 3): ("direct", 0)}


def test_a_key_with_a_sound_row_stands(spark):
    t = dt(2024, 1, 1)
    p = spark.createDataFrame([("k", t)], "key STRING, since TIMESTAMP")
    s = refs(spark, [("s", 1, "twice", "w", 0, "gone", t), ("s", 2, "twice", "w", 0, "k", t), ("s", 3, "both", "w", 0, "gone", t), ("s", 4, "both", "w", 0, "gone", t), ("s", 5, "free", "w", 0, "gone", t)])
    own = spark.createDataFrame([("twice", t), ("twice", t), ("both", t), ("both", t), ("free", t), ("free", None)], "key STRING, since TIMESTAMP")
    leaf = refs(spark, [("r", 1, None, "s", 0, "twice", t), ("r", 2, None, "s", 0, "both", t), ("r", 3, None, "s", 0, "free", t)])
    got = cascade(spark, {"p": p, "s": own}, [Reference("s", "p", s), Reference("r", "s", leaf)])
    assert sorted((r.src_table, r.row_id, r.kind) for r in got.collect()) == [("r", 2, "inherited"), ("s", 1, "direct"), ("s", 3, "direct"), ("s", 4, "direct"), ("s", 5, "direct")]


def test_a_loop_of_references_ends(spark):
    t = dt(2024, 1, 1)
    p = spark.createDataFrame([("k", t)], "key STRING, since TIMESTAMP")
    up = refs(spark, [("s", i, f"s{i}", "up", 0, f"s{(i + 1) % 4}", t) for i in range(4)])
    word = refs(spark, [("s", 2, "s2", "w", 0, "gone", t)])
    own = spark.createDataFrame([(f"s{i}", t) for i in range(4)], "key STRING, since TIMESTAMP")
    got = cascade(spark, {"p": p, "s": own}, [Reference("s", "p", word), Reference("s", "s", up)])
    assert sorted((r.row_id, r.field, r["round"]) for r in got.collect()) == [(0, "up", 2), (1, "up", 1), (2, "up", 4), (2, "w", 0), (3, "up", 3)]
