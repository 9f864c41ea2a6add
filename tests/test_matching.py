import random

import numpy as np
from pyspark.sql import functions as F

from nodeloom.operators import matching as M
from nodeloom.operators import simjoin as S


def vecs(spark, x, prefix="v"):
    return spark.createDataFrame([(f"{prefix}{i:04d}", [float(a) for a in v]) for i, v in enumerate(x)], "id STRING, vec ARRAY<DOUBLE>")


def test_greedy_equals_sequential(spark):
    r = random.Random(1)
    p = [(f"{a:02d}", f"{b:02d}", r.randrange(12) / 10) for a in range(30) for b in range(a + 1, 30) if r.random() < 0.3]
    taken, exp = set(), set()
    for a, b, s in sorted(p, key=lambda x: (-x[2], x[0], x[1])):
        if s >= 0.3 and a not in taken and b not in taken:
            taken |= {a, b}
            exp.add((a, b))
    d = spark.createDataFrame(p + p[:5] + [("q", "q", 2.0), (None, "x", 2.0)], "a STRING, b STRING, score DOUBLE")
    assert {(x.a, x.b) for x in M.greedy_by_score(spark, d, 0.3).collect()} == exp
    assert {(x.a, x.b) for x in M.greedy(spark, d.filter("score >= 0.3"), [-F.col("score")], in_task=0).collect()} == exp
    assert M.greedy_by_score(spark, d.limit(0), 0.3).count() == 0


def test_polysemy_floor(spark):
    d = spark.createDataFrame([("0", "1", 0.0, True), ("2", "3", 0.45, False)], "a STRING, b STRING, score DOUBLE, same BOOLEAN")
    assert [tuple(x) for x in M.greedy_by_score(spark, d, 0.5, 0.5).collect()] == [("0", "1", 0.0, 0.5)]


def test_tiers_equal_scan(spark):
    r = random.Random(4)
    rel = [(t, f"{a:02d}", f"{r.randrange(25):02d}", a, i) for i, (t, a) in enumerate((r.randrange(1, 4), r.randrange(25)) for _ in range(120))]
    taken, exp = set(), set()
    for t, a, b, oa, orel in sorted(rel, key=lambda x: (x[0], x[3], x[4])):
        if a != b and a not in taken and b not in taken:
            taken |= {a, b}
            exp.add((t, a, b))
    d = spark.createDataFrame(rel, "tier INT, a STRING, b STRING, ord_a INT, ord_rel INT")
    assert {(x.tier, x.a, x.b) for x in M.by_tiers(spark, d).collect()} == exp


def test_bridges_equal_loop(spark):
    rng = np.random.default_rng(3)
    c, b = rng.standard_normal((12, 6)), rng.standard_normal((10, 6))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    free, exp = set(range(10)), {}
    for i in range(12):
        if free:
            j = max(free, key=lambda j: c[i] @ b[j])
            free.discard(j)
            exp[f"p{i:04d}"] = f"b{j:04d}"
    pairs = vecs(spark, c, "p").select(F.col("id").alias("pair"), "vec").withColumn("rank", F.struct(F.col("pair")))
    bridges = vecs(spark, b, "b")

    def near(ps, k):
        g = S.nearest(ps.select(F.col("pair").alias("id"), "vec"), bridges, 6, k)
        return g.select(F.col("id").alias("pair"), F.col("match").alias("bridge"), "score", F.col("rank").alias("pref"))

    for first, in_task in ((2, None), (2, 0), (50, 0)):
        assert {x.pair: x.bridge for x in M.assign_bridges(spark, pairs, near, 10, first, in_task).collect()} == exp


def test_many_more_pairs_than_bridges(spark):
    rng = np.random.default_rng(5)
    c, b = rng.standard_normal((90, 4)), rng.standard_normal((20, 4))
    c, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (c, b))
    order = rng.permutation(90)
    rank = {int(p): int(r) for r, p in enumerate(order)}
    free, exp = set(range(20)), {}
    for p in order[:20]:
        j = max(free, key=lambda j: (round(float(c[p] @ b[j]), 12), -j))
        free.discard(j)
        exp[f"p{p:04d}"] = f"b{j:04d}"
    rows = spark.createDataFrame([(f"p{p:04d}", [float(v) for v in c[p]], rank[p]) for p in range(90)], "pair STRING, vec ARRAY<DOUBLE>, r INT")
    pairs, bridges, written = M.ranked(rows, F.col("r")), vecs(spark, b, "b"), []

    def near(ps, k):
        g = S.nearest(ps.select(F.col("pair").alias("id"), "vec"), bridges, 4, k)
        g = g.select(F.col("id").alias("pair"), F.col("match").alias("bridge"), "score", F.col("rank").alias("pref"))
        written.append(ps.count() * k)
        return g

    for first, in_task in ((5, None), (5, 0)):
        written.clear()
        assert {x.pair: x.bridge for x in M.assign_bridges(spark, pairs, near, 20, first, in_task).collect()} == exp
        assert written[0] == 20 * 5 and sum(written[1:]) <= 20 * 20


def test_joins_equal_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 16))
    x[7] = x[3]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u @ u.T
    d = vecs(spark, x).union(spark.createDataFrame([("bad1", None), ("bad2", [0.0] * 16), ("bad3", [1.0]), ("bad4", [float("nan")] * 16)], "id STRING, vec ARRAY<DOUBLE>"))
    exp = {(f"v{i:04d}", f"v{j:04d}") for i in range(300) for j in range(i + 1, 300) if sim[i, j] >= 0.5}
    assert {(r.a, r.b) for r in S.pairs_exact(d, 16, 0.5).collect()} == exp
    assert {(r.a, r.b) for r in S.pairs_exact(d, 16, 0.5, rows=100).collect()} == exp
    near = {r.id: r.match for r in S.nearest(d.filter("id < 'v0100'"), d.filter("id >= 'v0100'"), 16, rows=70).collect()}
    assert all(near[f"v{i:04d}"] == f"v{100 + int(np.argmax(np.round(sim[i, 100:], 12))):04d}" for i in range(100))
    hi = {(a, b) for a, b in exp if sim[int(a[1:]), int(b[1:])] >= 0.7}
    got = {(r.a, r.b) for r in S.pairs_approximate(spark, d, 16, 0.7, tables=40, bits=3, cell=30).collect()}
    knn = {}
    for i in range(300):
        for j in np.argsort(-np.round(sim[i], 12), kind="stable")[:6]:
            if i != j:
                knn.setdefault(i, []).append(int(j))
    exp = {(f"v{min(i, j):04d}", f"v{max(i, j):04d}") for i, js in knn.items() for j in js[:5]}
    assert {(r.a, r.b) for r in S.neighbour_pairs(d, 16, 5, -1.0).collect()} == exp
    assert [(r.a, r.b) for r in S.top_pairs(S.pairs_exact(d, 16, 0.5), 2).collect()][0] == ("v0003", "v0007")
    assert got <= hi and len(got) >= 0.9 * len(hi)
    assert S.top_k(d, x[5].tolist(), 3).first().id == "v0005"


def test_pairs_are_exact_beyond_one_block(spark):
    x = np.random.default_rng(8).standard_normal((2000, 64))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(u @ u.T >= 0.3, 1))
    got = S.pairs(spark, vecs(spark, x), 64, 0.3, rows=600).toPandas()
    assert len(got) == len(i) > 5000 and set(zip(got.a, got.b)) == {(f"v{a:04d}", f"v{b:04d}") for a, b in zip(i, j)}
    score = dict(zip(zip(got.a, got.b), got.score))
    assert all(abs(score[f"v{a:04d}", f"v{b:04d}"] - u[a] @ u[b]) < 1e-11 for a, b in zip(i, j))


def test_recall_holds_at_every_size_and_threshold(spark):
    rng = np.random.default_rng(11)
    for n, least, noise in ((400, 0.3, 1.4), (1600, 0.3, 1.4), (800, 0.72, 0.6), (2400, 0.72, 0.6), (1600, 0.9, 0.3)):
        c = rng.standard_normal((n // 8, 24))
        x = np.repeat(c, 8, 0) + noise * rng.standard_normal((n, 24))
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        i, j = np.nonzero(np.triu(u @ u.T >= least, 1))
        exp = {(f"v{a:04d}", f"v{b:04d}") for a, b in zip(i, j)}
        got = {(r.a, r.b) for r in S.pairs(spark, vecs(spark, x), 24, least, recall=0.95).collect()}
        assert got <= exp and len(got) >= 0.9 * len(exp) > 500, (n, least, len(got), len(exp))
    for bits, tables in (S.plan_cells(n, c, 0.95) for n in (10**4, 10**6, 10**8) for c in (0.3, 0.72, 0.9)):
        assert bits >= 1 and tables >= 1


def test_stored_index(spark, tmp_path):
    rng = np.random.default_rng(13)
    c = rng.standard_normal((40, 16))
    x = np.repeat(c, 20, 0) + 0.7 * rng.standard_normal((800, 16))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    S.write_index(spark, vecs(spark, x), 16, str(tmp_path / "i"), 0.6)
    hit = tot = 0
    for i in range(0, 800, 90):
        got = {r.id: r.score for r in S.search_index(spark, str(tmp_path / "i"), x[i].tolist(), 10).collect()}
        exp = [j for j in np.argsort(-(u @ u[i]))[:10] if u[j] @ u[i] >= 0.6]
        hit, tot = hit + sum(f"v{j:04d}" in got for j in exp), tot + len(exp)
        assert abs(got[f"v{i:04d}"] - 1) < 1e-9
    assert hit >= 0.9 * tot > 40


def test_hot_cell_of_copies(spark):
    x = np.vstack([np.tile([1.0, 0.0, 0.0], (90, 1)), np.tile([0.0, 1.0, 0.0], (5, 1))])
    got = S.pairs_approximate(spark, vecs(spark, x), 3, 0.99, tables=2, bits=1, cell=20)
    assert got.count() == 90 * 89 // 2 + 5 * 4 // 2


def test_dense_cell_of_different_vectors(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal(16) + 0.45 * rng.standard_normal((200, 16))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    on = u @ np.random.default_rng(3).standard_normal((1, 1, 16))[0].T > 0  # the only plane of the only table
    i, j = np.nonzero(np.triu((u @ u.T >= 0.8) & (on == on.T), 1))
    got = S.pairs_approximate(spark, vecs(spark, x), 16, 0.8, tables=1, bits=1, cell=20)
    assert {(r.a, r.b) for r in got.collect()} == {(f"v{a:04d}", f"v{b:04d}") for a, b in zip(i, j)} and len(i) > 1000


def test_pairs_within_groups(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((120, 8))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    g = ["hot" if i < 80 else f"g{i % 5}" if i < 110 else None for i in range(120)]
    d = spark.createDataFrame([(g[i], f"v{i:03d}", [float(a) for a in x[i]]) for i in range(120)] + [("hot", "bad", None)], "k STRING, id STRING, vec ARRAY<DOUBLE>")
    exp = {(g[i], f"v{i:03d}", f"v{j:03d}") for i in range(120) for j in range(i + 1, 120) if g[i] and g[i] == g[j] and u[i] @ u[j] >= 0.3}
    assert {(r.k, r.a, r.b) for r in S.pairs_within(d, ["k"], 8, 0.3, small=20, cell=15).collect()} == exp
