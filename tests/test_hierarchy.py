import random

from pyspark.sql import functions as F

from nodeloom.operators import hierarchy as H


def brute(par):
    out = {}
    for v in par:
        seen, u, k = {}, v, 0
        while True:
            if u in seen:
                ring = [x for x in seen if seen[x] >= seen[u]]
                out[v] = (min(ring), -1 if v in ring else -2)
                break
            seen[u] = k
            k += 1
            p = par[u]
            if not p or p not in par:
                out[v] = (u, k - 1)
                break
            u = p
    return out


def tree(spark, par):
    return spark.createDataFrame(list(par.items()), "id STRING, parent STRING")


def test_random_forest_with_loops(spark):
    r = random.Random(5)
    par = {f"{i:03d}": r.choice([None, "", "zz", f"{r.randrange(i + 1):03d}", f"{max(0, i - 1):03d}", f"{r.randrange(160):03d}"]) for i in range(160)}
    par |= {f"c{i:03d}": f"c{i - 1:03d}" if i else None for i in range(40)} | {f"h{i}": "c000" for i in range(30)}
    h = H.hierarchy(spark, tree(spark, par)).cache()
    exp = brute(par)
    assert {x.id: (x.root_id, x.depth) for x in h.collect()} == exp
    up = {}
    for v in par:
        if exp[v][1] >= 0:
            p, u = [v], v
            while par[u] in par:
                u = par[u]
                p.append(u)
            up[v] = p[::-1]
    paths = {x.id: x.path for x in H.full_paths(h, h.select("id")).collect()}
    assert paths == up
    below = {(a, v) for v, p in up.items() for a in p[:-1]}
    assert {tuple(x) for x in H.descendants(h, h.select("id")).collect()} == below
    assert all(len(x.segs) <= 8 for x in h.collect() if x.depth >= 0)


def test_empty_single_and_prefix(spark):
    assert H.hierarchy(spark, tree(spark, {"a": None}).limit(0)).count() == 0
    assert [tuple(x)[:3] for x in H.hierarchy(spark, tree(spark, {"a": "a"})).collect()] == [("a", "a", -1)]
    d = spark.createDataFrame([("g", f"{i:03d}", i) for i in range(50)], "g STRING, o STRING, v BIGINT")
    got = H.prefix_sum(d, "g", "o", "v", 50 * H.BUCKET_ROWS)
    rows = sorted(got.collect(), key=lambda x: x.before)
    total = 0
    for x in rows:
        if x.v:
            assert x.before == total
        total += x.v


def test_loops(spark):
    r = random.Random(2)
    e = [(f"{r.randrange(60):02d}", f"{r.randrange(60):02d}") for _ in range(75)] + [("aa", "aa"), ("b1", "b2"), ("b2", "b1"), ("b2", "aa"), ("b1", "b2")]
    adj = {}
    for a, b in e:
        adj.setdefault(a, set()).add(b)

    def reach(v):
        s, q = set(), list(adj.get(v, ()))
        while q:
            x = q.pop()
            if x not in s:
                s.add(x)
                q += adj.get(x, ())
        return s

    rs = {v: reach(v) for v in {x for p in e for x in p}}
    exp = {v: min(x for x in s if v in rs[x]) for v, s in rs.items() if v in s}
    d = spark.createDataFrame(e, "src STRING, dst STRING")
    for residue in (0, 10**6):
        assert {x.id: x.root_id for x in H.loop_members(spark, d, residue).collect()} == exp
    assert H.loop_members(spark, d.limit(0)).count() == 0


def test_long_loops_take_few_rounds(spark):
    n = 120
    e = [(f"a{i:03d}", f"a{(i + 1) % n:03d}") for i in range(n)] + [(f"z{i:03d}", f"z{(i - 1) % n:03d}") for i in range(n)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(n)]
    cuts = []
    cut = H.Scratch.cut
    H.Scratch.cut = lambda self, *a, **k: cuts.append(1) or cut(self, *a, **k)
    try:
        got = H.loop_members(spark, spark.createDataFrame(e, "src STRING, dst STRING"), 0)
    finally:
        H.Scratch.cut = cut
    assert {x.id: x.root_id for x in got.collect()} == {x: f"{x[0]}000" for x, _ in e if x[0] != "p"} and len(cuts) < 220


def test_latest_state(spark):
    d = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "y", 2), ("b", None, None), (None, "q", 9)], "id STRING, p STRING, updated_at INT")
    assert {tuple(x) for x in H.latest_states(d, "p").collect()} == {("a", "y"), ("b", None)}
