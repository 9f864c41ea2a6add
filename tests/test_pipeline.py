import json

import pytest
from pyspark.sql import functions as F

from nodeloom import cli
from nodeloom.options import Options
from nodeloom.plans import build as B
from nodeloom.plans import labels as L
from nodeloom.plans.api import GraphAPI
from nodeloom.plans.ingest import ingest, outcome_counts, settle, touched_words
from nodeloom.plans.stages import STAGES, StageOrderError, StageStore, preflight, run_stage
from nodeloom.sources import dictionary as D
from nodeloom.sources import sinks
from nodeloom.sources.terms import dedupe, read_terms
from nodeloom.streaming import incremental as I
from nodeloom.streaming.incremental import current, ingest_stream, stream_terms

WORDS = ["warm", "cold", "bright", "dim", "loud", "calm"]
OPT = Options(dim=16, q_min_leaf=0.0, triad_cosine=-1.0, polysemy_floor=0.0)


def dictionary():
    out = []
    for i, w in enumerate(WORDS):
        r = {"word": w, "pos": "adj", "senses": [{"glosses": [f"gloss of {w}"], "examples": [{"text": "e"}]}] + ([{"glosses": [""]}, {"glosses": [f"second {w}"], "id": "own"}] if i == 0 else []),
             "antonyms": [{"word": WORDS[i ^ 1], "_dis1": "80 20"}, {"word": ""}], "synonyms": [{"word": WORDS[(i + 2) % 6]}], "sounds": [{"ipa": "/t/", "tags": ["x"]}, {"ipa": "/p/"}], "forms": [{"form": w + "er"}]}
        out.append(json.dumps(r))
    return out + ['{"word": "fremd", "pos": "adj", "lang_code": "de", "senses": [{"glosses": ["x"]}]}', '{"word": "none", "pos": "n", "senses": []}', '{"word": "bro']


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("d") / "dump.jsonl"
    p.write_text("\n".join(dictionary()))
    w, s = D.parse_lines(D.read_lines(spark, str(p)))
    return w.cache(), s.cache(), str(p)


def test_parse(spark, parsed):
    w, s, path = parsed
    assert {r.word for r in w.collect()} == set(WORDS) and s.count() == 7
    warm = w.filter("word = 'warm'").first()
    assert warm.ipa == "/p/" and warm.sense_ids == ["warm-adj-0", "own"] and warm.forms == ["warmer"] and warm.lang_code == "en"
    assert [(r.kind, r.word, r.dis1) for r in warm.relations] == [("antonyms", "cold", [80, 20]), ("synonyms", "bright", [])]
    own = s.filter("sense_id = 'own'").first()
    assert own.sense_idx == 2 and own.embed_text == "second warm" and s.filter("sense_id = 'dim-adj-0'").first().embed_text == "gloss of dim e"
    assert D.parse_lines(D.read_lines(spark, path, 2))[0].count() == 2
    assert D.fixture_lines(D.read_lines(spark, path), ["fremd"], "de").count() == 1


@pytest.fixture(scope="module")
def built(spark, parsed):
    w, s, _ = parsed
    r = w.select("word", "pos", F.posexplode("relations").alias("at", "r"), "ord").select((F.col("ord") * 100 + F.col("at")).alias("row_id"), "word", "pos", "r.kind", F.col("r.word").alias("target"))
    g = B.build_graph(spark, w.select("word", "pos", "sense_ids", "ord"), s.withColumn("doi", F.array(F.lit("10.1/x"))), r, OPT)
    return {k: v.cache() for k, v in g.items()}


def test_build(spark, built):
    assert built["words"].filter("vec IS NULL").count() == 0 and built["senses"].filter("parent_edge_id IS NULL").count() == 0
    leaf, we, tri = (built[k].collect() for k in ("leaf_edges", "word_edges", "triads"))
    assert len(leaf) == 4 and {r.source for r in leaf} == {"inferred"} and sum(len(r.member_ids) for r in leaf) == 7
    assert {r.edge_type for r in we} == {"contradicts"} and len(we) == 3 and all(r.q == 0.85 and r.confidence == 1.0 for r in we)
    assert tri and all(r.level == 13 for r in tri if set(r.member_ids) & {x.id for x in leaf}) and all(0 <= r.connection_strength <= 1 for r in tri)
    for r in tri:
        assert abs(sum(x * x for x in r.vec) - 1) < 1e-9 and abs(r.accumulated_weight - r.connection_strength * (1 + 0.5 * (14 - r.level) / 13)) < 1e-12
    assert {r.node_id for r in built["provenance"].collect()} >= {r.id for r in leaf}


def test_sweep_ends(spark):
    d = spark.createDataFrame([(f"{lv}{i}", [1.0, 0.01 * i], 0.5, lv) for lv, n in ((15, 6), (14, 3)) for i in range(n)], "id STRING, vec ARRAY<DOUBLE>, w DOUBLE, level INT")
    t, h = B.sweep(spark, d, 2)
    assert sorted(r.level for r in t.collect()) == [13, 13, 13] and sum(r.n for r in h.collect()) == 3


def test_api(spark, built):
    n = built["senses"].select("id", F.lit("node").alias("doc_type"), F.lit("sense").alias("node_type"), F.lit(15).alias("level"), "word", "pos", "sense_id", "parent_edge_id", F.concat("word", F.lit(" (adj)")).alias("label"))
    w = built["words"].select("id", F.lit("node").alias("doc_type"), F.lit("word").alias("node_type"), F.lit(14).alias("level"), "word", "pos", F.concat("word", F.lit(" (adj)")).alias("label"))
    up = built["triads"].select(F.col("id").alias("parent_edge_id"), F.explode("member_ids").alias("id"))
    g = n.unionByName(w, allowMissingColumns=True)
    for k in ("leaf_edges", "word_edges", "triads"):
        e = built[k].drop("vec", "type_vec", "member_ids", "child_cosine").withColumn("doc_type", F.lit("edge")).join(up, "id", "left")
        g = g.unionByName(e, allowMissingColumns=True)
    v = n.select("id").join(built["senses"].select("id", "vec"), "id")
    for k in ("words", "leaf_edges", "word_edges", "triads"):
        v = v.unionByName(built[k].select("id", "vec"))
    a = GraphAPI(spark, g.cache(), v.cache(), built["provenance"], OPT)
    assert a.find_word("warm").first().degree == 1 and a.word_senses("warm").count() == 2 and a.word_edges("warm").first().partner_label == "cold (adj)"
    hit = a.semantic_search("gloss of dim e", "node", 1).first()
    assert hit.label == "dim (adj)" and hit.score > 0.999
    c = a.context_search("gloss of dim e", top_k=2)
    assert c["hits"].count() == 2 and c["ancestors"].count() >= 1
    t = built["triads"].first().id
    assert a.edge_info(t)["branches"].count() == 3 and a.leaf_nodes(t).count() > 0 and a.scan_unlabeled(13).count() >= 1 and a.sample_triads(13, 1)["branches"].count() >= 3
    leaf = built["leaf_edges"].first().id
    assert a.traverse_up(built["senses"].first().id).count() >= 1 and a.graph_stats().count() >= 4
    e = a.context_search("gloss of dim e", "edge", 2, 1)
    assert e["senses"].groupBy("hit").count().filter("count > 1").count() == 0 < e["senses"].count() and {r.sense_count for r in c["hits"].collect()} <= {str(i) for i in range(9)} and c["ancestor_branches"].count() >= 0
    for bad in (9, 14):
        with pytest.raises(ValueError):
            a.scan_unlabeled(bad)
        with pytest.raises(ValueError):
            a.sample_triads(bad)
    sid, b = a.create_sense("hum", "noun", "a low sound", ["it hums"], ["rare"], ["music"])
    made = b.graph.filter(F.col("id") == sid).first()
    assert (made.gloss, made.examples, made.tags, made.topics, made.label, made.sense_idx) == ("a low sound", ["it hums"], ["rare"], ["music"], "hum (noun) [0]", 0)
    wid, b = b.create_word("hum", "noun", [sid, sid], "/h/", "old")
    made = b.graph.filter(F.col("id") == wid).first()
    assert (made.ipa, made.etymology, made.surface) == ("/h/", "old", 1)
    eid, b = b.create_edge(wid, b.find_word("loud").first().id, "extends")
    assert b.find_word("hum").first().degree == 1 and [(r.q, r.source, r.confidence, len(r.type_vector)) for r in b.graph.filter(F.col("id") == eid).collect()] == [(0.6, "ingested", 1.0, 16)]
    with pytest.raises(ValueError):
        b.create_edge(sid, wid)
    with pytest.raises(ValueError):
        a.create_word("x", "n", ["nope"])
    l2 = [r.id for r in built["leaf_edges"].limit(2).collect()]
    tid, b, told = a.create_structural_triad(l2[0], l2[1], built["word_edges"].first().id, " me ")
    assert told["author"] == "me" and -1 <= told["child_cosine"] <= 1 and told["level"] == 13 and b.graph.filter(F.col("id") == tid).first().author == "me"
    with pytest.raises(ValueError):
        a.create_structural_triad(l2[0], l2[1], built["word_edges"].first().id, "x" * 201)
    assert b.graph.filter(F.col("id") == tid).first().bridge_id and b.set_label(tid, "light", [0.0] * 16, "m").graph.filter(F.col("id") == tid).first().semantic_label == "light"
    with pytest.raises(ValueError):
        a.set_label(leaf, "light", [0.0] * 16, "m")


def test_labels(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    ok = {"key": "t", "status": {"code": 0}, "response": {"candidates": [{"content": {"parts": [{"text": json.dumps({"semantic_label": "warm light"})}]}}]}}
    p.write_text("\n".join([json.dumps(ok), json.dumps(ok | {"key": "u", "status": {"code": 3}}), "junk"]))
    assert [tuple(r) for r in L.answers(spark, str(p)).collect()] == [("t", "warm light")]


BATCH = [{"doi": "10.1/a", "terms": [{"id": "1", "term": "warm  tone", "gloss": "g"}, {"id": "2", "term": "", "gloss": "g"}, {"id": "3", "term": "warm", "gloss": "gloss of warm e"}]},
         {"doi": "(no doi)", "extracted": {"doi": "10.1/in", "terms": [{"id": "1", "term": "warm tone", "gloss": "g"}, {"id": "9", "term": "warm", "gloss": "new"}]}}]


def test_terms_and_ingest(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, BATCH)) + "\nbroken")
    t = read_terms(spark, str(tmp_path))
    assert t.count() == 4 and {r.doi for r in t.collect()} == {"10.1/a", None}
    d = dedupe(t)
    assert d.count() == 3 and d.filter("gloss = 'g'").first().dois == ["10.1/a"]
    from nodeloom.functions.embed import embed

    s = spark.createDataFrame([("s1", "warm", "adj", "gloss of warm e")], "id STRING, word STRING, pos STRING, g STRING").select("id", "word", "pos", embed(F.col("g"), Options(dim=16)).cast("array<double>").alias("vec"))
    w = s.select("word", "pos", F.lit(1).alias("ord"), "vec")
    got = ingest(spark, t, w, s, 16)
    assert {(r.word, r.gloss): (r.pos, r.outcome) for r in got.collect()} == {("warm  tone", "g"): ("noun", "new_word"), ("warm", "gloss of warm e"): ("adj", "merged"), ("warm", "new"): ("adj", "new_sense")}
    assert {r.outcome: r.n for r in outcome_counts(got).collect()} == {"new_word": 1, "merged": 1, "new_sense": 1}
    assert sorted(map(tuple, touched_words(got).collect())) == [("warm", "adj"), ("warm  tone", "noun")]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, BATCH)))
    ingest_stream(stream_terms(spark, str(tmp_path / "in"), 1), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert current(spark, str(tmp_path / "t")).count() == 4
    (tmp_path / "in/b.json").write_text(json.dumps({"doi": "10.1/a", "terms": [{"id": "3", "term": "warm", "gloss": "changed"}, {"id": "7", "term": "z", "gloss": "z"}]}))
    ingest_stream(stream_terms(spark, str(tmp_path / "in"), 1), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    r = {x.sense_id: x.gloss for x in current(spark, str(tmp_path / "t")).collect()}
    assert len(r) == 5 and r["batch:10.1/a:3"] == "changed"
    # only the touched buckets were written again, and a repeated batch changes nothing
    versions = I._versions(spark, str(tmp_path / "t"))
    assert sum(v[-1] == 1 for v in versions.values()) <= 2 < len(versions)
    I.write_batch(current(spark, str(tmp_path / "t"), 1).limit(0), 1, str(tmp_path / "u"), "sense_id")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "sense_id STRING, x INT")
    for n, d in ((0, rows), (1, rows.filter("x = 2").withColumn("x", F.lit(3))), (1, rows.filter("x = 2").withColumn("x", F.lit(3))), (2, rows.filter("x = 2").withColumn("x", F.lit(4)))):
        I.write_batch(d, n, str(tmp_path / "w"), "sense_id")
    assert sorted(map(tuple, current(spark, str(tmp_path / "w")).collect())) == [("a", 1), ("b", 4)] and max(map(len, I._versions(spark, str(tmp_path / "w")).values())) == 2


def test_ingest_stream_sees_earlier_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    w = spark.createDataFrame([("warm", "adj", 1, None)], "word STRING, pos STRING, ord INT, vec ARRAY<DOUBLE>")
    s = spark.createDataFrame([], "id STRING, word STRING, pos STRING, vec ARRAY<DOUBLE>")
    for i, (term, gloss) in enumerate([("warm", "g1"), ("new", "g2"), ("warm", "g1"), ("new", "g3"), ("new", "g2")]):
        (tmp_path / f"in/{i}.json").write_text(json.dumps({"doi": f"10.1/{i}", "terms": [{"id": "t", "term": term, "gloss": gloss}]}))
        I.ingest_graph_stream(stream_terms(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c"), w, s, 16).awaitTermination()
    got = {r.sense_id: (r.outcome, r.pos, r.merged_into) for r in current(spark, str(tmp_path / "t")).collect()}
    assert got == {"batch:10.1/0:t": ("new_sense", "adj", None), "batch:10.1/1:t": ("new_word", "noun", None), "batch:10.1/2:t": ("merged", "adj", "batch:10.1/0:t"),
                   "batch:10.1/3:t": ("new_sense", "noun", None), "batch:10.1/4:t": ("merged", "noun", "batch:10.1/1:t")}


def test_hot_word_settles_like_the_sequence(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    c = rng.standard_normal((25, 6))
    x = c[rng.integers(0, 25, 300)] + 0.25 * rng.standard_normal((300, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    known, exp = [("k0", x[0]), ("k1", x[1])], {}
    seen = list(known)
    for i in range(2, 300):
        score, to = max(((round(float(v @ x[i]), 12), -n) for n, (_, v) in enumerate(seen)))
        if score >= 0.9:
            exp[f"s{i}"] = ("merged", seen[-to][0])
        else:
            exp[f"s{i}"] = ("new_sense", None)
            seen.append((f"s{i}", x[i]))
    t = spark.createDataFrame([(i, "hot", f"s{i}", "g", [], [float(v) for v in x[i]]) for i in range(2, 300)], "ord BIGINT, word STRING, sense_id STRING, gloss STRING, dois ARRAY<STRING>, vec ARRAY<DOUBLE>")
    w = spark.createDataFrame([("hot", "noun", 1, None)], "word STRING, pos STRING, ord INT, vec ARRAY<DOUBLE>")
    s = spark.createDataFrame([(k, "hot", "noun", [float(a) for a in v]) for k, v in known], "id STRING, word STRING, pos STRING, vec ARRAY<DOUBLE>")
    got = {r.sense_id: (r.outcome, r.merged_into) for r in settle(spark, t, w, s, 6, 0.9).collect()}
    assert got == exp and len({v[0] for v in exp.values()}) == 2


def test_stages(spark, tmp_path):
    s = StageStore(str(tmp_path), spark)
    with pytest.raises(StageOrderError):
        run_stage(s, "embed", lambda st: 1)
    assert run_stage(s, "parse", lambda st: 3) == 3 and run_stage(s, "parse", lambda st: 3) is None and s.load("parse").processed == 3
    assert run_stage(s, "embed", lambda st: 2, dry_run=True) == 2 and not s.load("embed").done
    run_stage(s, "embed", lambda st: 2)
    assert run_stage(s, "parse", lambda st: 4, reset=True) == 4 and not s.load("embed").done
    with pytest.raises(KeyError):
        s.begin("nothing")
    assert len(STAGES) == 10
    c = preflight(spark, [__file__, "/nowhere"], [str(tmp_path), "/nowhere"], 0.0)
    assert c["session"] and c[f"input {__file__}"] and not c["input /nowhere"] and c[f"writable {tmp_path}"] and not c["writable /nowhere"]


def test_command_line(spark, parsed, tmp_path, capsys):
    def run(*a):
        return cli.main([*a, "--work", str(tmp_path)], spark, OPT)

    assert cli.main(["nothing", "--work", "x"], spark) == 2 and run("embed") == 1 and run("preflight", "--dictionary", parsed[2]) == 0
    assert run("parse", "--dictionary", parsed[2], "--dry-run") == 0 and not (tmp_path / "words").exists()
    assert run("parse", "--dictionary", parsed[2]) == 0 and run("parse", "--dictionary", parsed[2]) == 1
    for stage in STAGES[1:]:
        assert run(stage) == 0, stage
    d = spark.read.parquet(str(tmp_path / "documents"))
    n = {(r.doc_type, r.level): r.n for r in d.groupBy("doc_type", "level").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n["node", 15] == 7 and n["node", 14] == 6 and n["edge", 15] == 4 and n["edge", 14] == 3 and d.filter("doc_type = 'node' AND parent_edge_id IS NULL").count() == 0
    assert run("leaf_edges", "--force") == 0 and spark.read.parquet(str(tmp_path / "leaf_edges")).count() == 4
    v = {r.id: r.vec for r in spark.read.parquet(str(tmp_path / "word_vectors")).collect()}
    one = sorted(v)[0]
    (tmp_path / "ids.json").write_text(json.dumps([one]))
    assert run("word_vectors", "--force", "--word-ids-file", str(tmp_path / "ids.json")) == 0
    again = {r.id: r.vec for r in spark.read.parquet(str(tmp_path / "word_vectors")).collect()}
    assert again.keys() == v.keys() and all(max(abs(a - b) for a, b in zip(again[k], v[k])) < 1e-9 for k in v)
    assert run("embed", "--reset", "--limit", "3", "--batch-size", "2") == 0 and spark.read.parquet(str(tmp_path / "senses_embedded")).count() == 4 and run("leaf_edges") == 1


def scan_triads(children, bridges, level, least):
    """The sequential forming of one level: (members, vector, weight) over dicts id -> (vector, weight)."""
    import numpy as np

    cos = lambda a, b: round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 12)
    ids, taken, out, free = sorted(children), set(), [], set(bridges)
    for s, a, b in sorted(((-cos(children[a][0], children[b][0]), a, b) for i, a in enumerate(ids) for b in ids[i + 1 :])):
        if -s >= least and a not in taken and b not in taken:
            taken |= {a, b}
            if free:
                c = children[a][0] / np.linalg.norm(children[a][0]) * np.linalg.norm(children[a][0]) + children[b][0]
                g = min(free, key=lambda x: (-cos(c, bridges[x][0]), x))
                free.discard(g)
                w = [children[a][1], children[b][1], bridges[g][1]]
                v = w[0] * children[a][0] + w[1] * children[b][0] + w[2] * bridges[g][0]
                raw = w[2] ** 2 / np.sqrt(sum(x**4 for x in w))
                out.append(((a, b, g), v / np.linalg.norm(v), raw * (1 + 0.5 * (14 - (level - 2)) / 13)))
    return out


def test_levels_and_sweep_equal_the_sequence(spark):
    import hashlib

    import numpy as np

    rng = np.random.default_rng(12)
    c = rng.standard_normal((4, 5))
    docs = {}
    for level, n in ((15, 10), (14, 6), (13, 2)):
        for i in range(n):
            v = c[i % 4] + 0.5 * rng.standard_normal(5)
            docs[f"{level}-{i:02d}"] = (v / np.linalg.norm(v), 0.5 + 0.02 * i, level)
    frame = spark.createDataFrame([(k, [float(x) for x in v], float(w), lv) for k, (v, w, lv) in docs.items()], "id STRING, vec ARRAY<DOUBLE>, w DOUBLE, level INT")

    def passes(docs, least, until_empty):
        docs, gone, out = dict(docs), set(), []
        while True:
            added, level = 0, 15
            while level - 2 >= 1:
                one, two = ({k: x[:2] for k, x in docs.items() if x[2] == lv and k not in gone} for lv in (level, level - 1))
                made = scan_triads(one, two, level, least(level))
                if not made and not (until_empty and not one and level == 15 and not added):
                    break
                for m, v, w in made:
                    k = hashlib.sha256("|".join([str(level - 2), *m]).encode()).hexdigest()[:24]
                    docs[k] = (v, w, level - 2)
                    gone |= set(m)
                    out.append(m)
                added += len(made)
                level -= 1
            if not until_empty or not added:
                return out

    got = [tuple(r.member_ids) for r in B.build_levels(spark, frame, 5, 0.6).collect()]
    assert sorted(got) == sorted(passes(docs, lambda _: 0.6, False)) and got
    t, _ = B.sweep(spark, frame, 5, 0.9, lambda level: 0.6 - 0.01 * level)
    assert sorted(tuple(r.member_ids) for r in t.collect()) == sorted(passes(docs, lambda level: min(0.9, 0.6 - 0.01 * level), True))


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a", 14), ("b", 15), ("a", 14)], "id STRING, level INT")
    sinks.write_touched(d, str(tmp_path / "t"))
    assert sorted(r.id for r in D.word_scope(spark, str(tmp_path / "t")).collect()) == ["a", "b"]
    (tmp_path / "ids.json").write_text('["x", "y", "x", null]')
    assert sorted(r.id for r in D.word_scope(spark, str(tmp_path / "ids.json")).collect()) == ["x", "y"]
    (tmp_path / "h.json").write_text('[{"word_a": "a", "gloss_a": "g", "word_b": "b"}]')
    assert [tuple(r) for r in sinks.read_holdout(spark, str(tmp_path / "h.json")).collect()] == [("a", "g", "b")]
    assert D.resume_after(d, "id", "a").count() == 1 and D.resume_after(d, "id", None).count() == 3
    sinks.layout(spark, d, "graph_layout", 4)
    j = spark.table("graph_layout").alias("x").join(spark.table("graph_layout").alias("y"), "id").hint("merge")
    assert j.count() == 5 and sinks.exists(d) and not sinks.exists(d.limit(0))
    assert sinks.insert(d.drop("id").distinct(), str(tmp_path / "i"), "level").count() == 2
