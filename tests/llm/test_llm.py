import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeloom.llm import encode as E
from nodeloom.llm import languages as L
from nodeloom.llm import mixing as M
from nodeloom.llm import similar as S
from nodeloom.llm import unify as U
from nodeloom.llm.vamana import PrunedGraph


def test_unify(spark):
    v = [("word", "água"), ("word", "água"), ("word", "аgua"), ("word", "Água"), ("ipa", "g"), ("word", "g"), ("word", None), ("word", ""), ("word", "​"), ("word", "água")]
    d = spark.createDataFrame([(i, k, x, 1) for i, (k, x) in enumerate(v)], "row_id INT, kind STRING, value STRING, canonical2 INT")
    got = {r.row_id: r.canonical for r in U.unified(spark, d).collect()}
    assert got == {0: "água", 1: "água", 2: "agua", 3: "Água", 4: "ɡ", 5: "g", 6: None, 7: "", 8: "", 9: "água"}
    assert U.unified(spark, d.limit(0)).count() == 0
    # spelled apart in two ways, composed by nobody: the class decides, its members' own characters do not agree
    apart = [("word", "ậx"), ("word", "ậx"), ("word", "ậx"), ("ipa", "ậx")]
    got = U.unified(spark, spark.createDataFrame([(i, k, x) for i, (k, x) in enumerate(apart)], "row_id INT, kind STRING, value STRING")).collect()
    assert {r.row_id: r.canonical for r in got} == {0: "ậx", 1: "ậx", 2: "ậx", 3: "ậx"}


def test_graph_recall():
    rng = np.random.default_rng(0)
    c = rng.standard_normal((40, 32))
    x = (c[rng.integers(0, 40, 4000)] + 0.5 * rng.standard_normal((4000, 32))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = PrunedGraph(x)
    q = x[:200]
    ids, dist = g.search(q, 32)
    true = np.argsort(-(q @ x.T), 1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) for a, b in zip(ids, true)]) >= 9 and (g.deg <= g.slots).all()
    assert (np.diff(dist[:, :10], axis=1) >= 0).all()
    assert PrunedGraph(x[:1]).search(q[:2], 4)[0][:, 0].tolist() == [0, 0]


def vectors(spark, x):
    return spark.createDataFrame([(f"v{i:05d}", [float(a) for a in r]) for i, r in enumerate(x)], "id STRING, vec ARRAY<FLOAT>")


def test_most_similar(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 16))
    x[5:30] = x[4]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 9)
    np.fill_diagonal(sim, -9)
    d = vectors(spark, x).repartition(3)
    q = d.filter("id < 'v00100'")
    exp = {f"v{i:05d}": {f"v{j:05d}" for j in np.argsort(-sim[i], kind="stable")[:10]} for i in range(100)}
    both = []
    for kw in ({"shard": 200}, {"shard": 200, "tile": 60}):
        got = {}
        for r in S.most_similar(spark, d, q, dim=16, **kw).collect():
            got.setdefault(r["query"], set()).add(r.neighbour)
        assert np.mean([len(got[k] & v) for k, v in exp.items()]) >= 9.3
        both.append(got)
    assert both[0] == both[1]
    hot = {r.neighbour for r in S.most_similar(spark, d, d.filter("id = 'v00010'"), dim=16, shard=200).collect()}
    assert hot == {f"v{i:05d}" for i in range(4, 15) if i != 10}
    assert S.most_similar(spark, d, d.limit(0), dim=16).count() == 0
    assert S.most_similar(spark, d.limit(3), d.limit(1), dim=16).count() == 2


def recall(spark, x, k=10, **kw):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 9)
    np.fill_diagonal(sim, -9)
    d = vectors(spark, x)
    got = {}
    for r in S.most_similar(spark, d, d, k=k, dim=x.shape[1], **kw).collect():
        got.setdefault(int(r["query"][1:]), set()).add(int(r.neighbour[1:]))
    # a neighbour counts if it is as near as the k-th
    edge = -np.sort(-sim, 1)[:, k - 1]
    return np.mean([sum(sim[i, j] >= edge[i] for j in got[i]) for i in range(len(x))]) / k


def test_every_vector_as_query(spark):
    rng = np.random.default_rng(7)
    assert recall(spark, rng.standard_normal((3000, 64)), shard=1600, tile=1000) >= 0.93
    copies = np.repeat(rng.standard_normal((30, 16)), 100, 0)
    assert recall(spark, copies, shard=700, tile=1100) == 1.0


def test_usable_and_distinct(spark):
    rows = [("a", [1.0, 0.0]), ("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [float("nan"), 1.0]), ("e", [float("inf"), 1.0]), ("f", [None, 1.0]), ("g", [1.0]), (None, [1.0, 1.0]), ("h", [0.0, -2.0])]
    d = spark.createDataFrame(rows, "k STRING, v ARRAY<FLOAT>").withColumn("id", F.lit("clash"))
    assert {r.id for r in S.distinct_vectors(d, "k", "v", 2).collect()} == {"a", "h"}
    two = spark.createDataFrame([("a", [2.0, 0.0]), ("a", [1.0, 5.0]), ("a", None)], "k STRING, v ARRAY<FLOAT>")
    assert [r.vec for r in S.distinct_vectors(two, "k", "v", 2).collect()] == [[1.0, 5.0]]


def test_encode_round_trip(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(E.RANKS.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    e, rng = E.encoder(), random.Random(1)
    alpha = list("\x1c\x00 　 \n\t \xa0ab'sllre1239.!,é漢字😀\xad​ß<|endoftext|>àÀ\x0b\x85")
    for _ in range(3000):
        s = "".join(rng.choice(alpha) for _ in range(rng.randint(0, 40)))
        assert e.ids(s) == t.encode(s, add_special_tokens=False).ids
    back = {v: k for k, v in e.ranks.items()}
    long = "漢a " * 50_000
    assert b"".join(back[i] for i in e.ids(long)).decode() == long
    d = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "a b", 7), (3, "a b", 7)], "doc_id BIGINT, text STRING, ids INT")
    assert sorted((r.doc_id, r.ids) for r in E.encoded(d).collect()) == [(1, []), (2, []), (3, [64, 275]), (3, [64, 275])]
    assert E.encoded(d.limit(0)).count() == 0
    assert sorted((r.doc_id, r.tokens) for r in E.token_counts(d).collect()) == [(1, 0), (2, 0), (3, 2), (3, 2)]


def test_certain_cuts():
    e = E.encoder()
    rng = random.Random(5)
    for _ in range(300):
        piece = "".join(rng.choice("aetinosr 漢ß1") for _ in range(rng.randint(1, 30))).encode()
        assert e.merge_plainly(piece) == list(e.merge(piece))
    for p in ("zq漢xkcd".encode(), b"abc", bytes(range(65, 200))):
        parts = e.certain_cuts(p)
        assert b"".join(parts) == p and all(not e.inside[a[-1], b[0]] for a, b in zip(parts, parts[1:]))


def test_water_fill():
    s = M.water_fill([M.Share("a", 0.5, 1, 100), M.Share("b", 0.3, 2, 100), M.Share("c", 0.2, 9, 100), M.Share("d", 0.0, 9, 100), M.Share("e", 0.5, 9, 0)], 400)
    w = {x.source: round(x.wanted, 6) for x in s}
    assert w == {"a": 100, "b": 180, "c": 120, "d": 0, "e": 0}
    assert sum(x.wanted for x in M.water_fill([M.Share("a", 1.0, 2, 10)], 1000)) == 20


def test_draw(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None, "x"]), rng.choice([0, 1, 7, 30, 400])) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id BIGINT, source STRING, tokens BIGINT")
    t = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.2, 1), ("gone", 0.1, 4)], "source STRING, target_share DOUBLE, max_repeats INT")
    sh = M.allotment(d, t)
    got = M.draw(spark, d, sh).collect()
    cap, size = {"a": 1, "b": 2, "c": 1}, {i: n for i, _, n in rows}
    assert len({r.doc_id for r in got}) == len(got) and all(1 <= r.copies <= cap[r.source] for r in got)
    for s in sh:
        n = sum(size[r.doc_id] * r.copies for r in got if r.source == s.source)
        assert s.wanted - 401 <= n <= s.wanted + 1
    assert got == M.draw(spark, d.repartition(5), sh).collect() or sorted(got) == sorted(M.draw(spark, d.repartition(5), sh).collect())
    rep = {r.source: r for r in M.report(spark, d, M.draw(spark, d, sh), sh).collect()}
    assert rep["gone"].drawn == 0 and rep[None].actual_share == 0 and rep["x"].actual_share == 0 and abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-9
    assert M.draw(spark, d.limit(0), M.allotment(d.limit(0), t)).count() == 0


SAMPLES = {
    "en": ["the old word was first noted in letters", "this meaning is a kind name for wooden bowls", "the plural can be used without an object", "it was borrowed through trade along the coast", "the entry should not be confused with its neighbour"],
    "de": ["das alte Wort wurde zuerst in Briefen notiert", "diese Bedeutung ist ein Name für hölzerne Schalen", "die Mehrzahl steht mit oder ohne Ergänzung", "es kam durch den Handel an der Küste ins Land", "der Eintrag ist nicht mit dem Nachbarn zu verwechseln"],
    "ru": ["старое слово впервые отмечено в письмах", "это значение обозначает пустые сундуки", "форма стоит с дополнением или без него", "оно пришло через торговлю вдоль берега", "статью не следует путать с соседней"],
}


@pytest.fixture(scope="module")
def model():
    return L.fitted([(k, x) for k, v in SAMPLES.items() for x in v[:4]], [])


def test_held_out(model):
    assert all(L.segments(v[4] + ".", model)[0][1] == k for k, v in SAMPLES.items())
    z = L.segments("The word is noted in letters.", model)[0]
    assert z[0] == 0 and z[2] > 0.9


def test_segments(model):
    en, de = "The old word was first noted in the letters.", "Das alte Wort wurde zuerst in den Briefen notiert."
    assert [(a, x) for a, x, _ in L.segments(f"{en} {de}\n(2) {de} {en}", model)] == [(0, "en"), (len(en) + 1, "de"), (len(en) + len(de) * 2 + 7, "en")]
    assert [(a, x) for a, x, _ in L.segments(f'kopfwort /ˈkɔ.pf/\n{en} AAAA 3.14 https://x.y/z?a=1', model)] == [(0, "en")]
    assert [(a, x) for a, x, _ in L.segments(de.upper(), model)] == [(0, "de")]
    assert [x for _, x, _ in L.segments(f'The word "das alte Wort wurde zuerst notiert" was first noted.', model)] == ["en"]
    assert [x for _, x, _ in L.segments("Thе оld wоrd was first nоted.", model)] == ["en"]
    for t in (None, "", "  \n", "42 ***", "…", "zzkrf"):
        assert L.segments(t, model) == []
    assert len(L.segments(" ".join([en] * 3000), model)) == 1


def test_nothing_is_left_out_for_want_of_a_mark(model):
    en, de = "The old word was first noted in the letters.", "Diese Bedeutung ist ein Name für hölzerne Schalen und das Wort steht ohne Ergänzung"
    for gap in (" ", "\n"):
        got = L.segments(en + gap + de, model)
        assert [(a, x) for a, x, _ in got] == [(0, "en"), (len(en) + 1, "de")] and all(c > 0.99 for _, _, c in got)
    lines = ["the old word was noted in letters", "das alte Wort wurde in Briefen notiert", "diese Bedeutung ist ein Name für Schalen"]
    assert [(a, x) for a, x, _ in L.segments("\n".join(lines), model)] == [(0, "en"), (len(lines[0]) + 1, "de")]
    assert [(a, x) for a, x, _ in L.segments(f"zkrf vlimp\n{de}\nqrx", model)] == [(0, "de")]


def test_scores_of_many_words_equal_those_of_one(model):
    words = ["wort", "letters", "словом", "zzz", "a", "wortwortwort" * 3, "briefe" * 40]
    many = model.score(words)
    for w, row in zip(words, many):
        x = model._long(w)
        one = np.log(np.maximum(x, 1e-300))
        assert np.allclose(row, np.maximum(one - one.max(), -L.WORD_MOST), atol=1e-9)


def test_another_script_and_a_ninth_language():
    samples = [(k, x) for k, v in SAMPLES.items() for x in v] + [("el", x) for x in ("η παλιά λέξη σημειώθηκε πρώτα σε γράμματα", "αυτή η σημασία είναι ένα όνομα για ξύλινα μπολ")]
    m = L.fitted(samples, [("el", "η λέξη είναι ένα όνομα.")])
    assert [x for _, x, _ in L.segments("αυτή η λέξη είναι παλιά και ξύλινα γράμματα", m)] == ["el"] and "el" in m.langs


def test_labelled_sample_does_not_depend_on_copies(spark):
    d = spark.createDataFrame([(i, "en", f"text {i % 40}") for i in range(200)] + [(i, "en", "hot") for i in range(300)], "doc_id BIGINT, lang STRING, text STRING")
    a = L.labelled_sample(d, ["en"])
    assert len(a) == 41 and a == L.labelled_sample(d.repartition(7), ["en"])


def test_labels(spark):
    codes = {"EN": "en", "eng": "en", "en-GB": "en", "deu": "de", "xx": None, "": None, None: None, "unknown": None, "pt_BR": "pt", " fr ": "fr", "english": "en", "enx": None}
    langs = ["de", "en", "fr", "pt", "xq"]
    codes |= {"XQ": "xq", "xq-AA": "xq", "ru": None, "rus": None}
    assert {k: L.label_code(k, langs) for k in codes} == codes
    d = spark.createDataFrame([(k,) for k in codes], "l STRING").select("l", L.code_column(F.col("l"), langs).alias("c"))
    assert {r.l: r.c for r in d.collect()} == codes


def test_language_frame(spark):
    s = spark.createDataFrame([(i, k, x) for k, v in SAMPLES.items() for i, x in enumerate(v)], "sample_id BIGINT, lang STRING, text STRING")
    docs = [(1, "en", "The old word was first noted in letters."), (2, "de", "The old word was first noted in letters."), (3, None, SAMPLES["ru"][0] + "."), (4, "eng", "This meaning is a kind name. Diese Bedeutung ist ein Name für die Mehrzahl."), (5, None, None), (6, "xx", "42")]
    d = spark.createDataFrame([(*x, 1.0) for x in docs], "doc_id BIGINT, lang STRING, text STRING, confidence DOUBLE")
    g = L.language_segments(d, s)
    got = sorted(tuple(r)[0:1] + (r.seg_start, r.lang) for r in g.filter(L.is_case(F.col("code"), F.col("lang"), F.col("n_segments"))).collect())
    assert got == [(2, 0, "en"), (3, 0, "ru"), (4, 0, "en"), (4, 29, "de")]
    assert L.language_segments(d.limit(0), s).count() == 0 and L.language_segments(d, s.limit(0)).count() == 0
