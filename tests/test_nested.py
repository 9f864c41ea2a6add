import json

from nodeloom.operators import nested as N


def test_found(spark):
    rec = {"word": "w", "senses": [None, {"glosses": ["g", None, " "], "examples": ["bare", {"text": "t"}, {"text": None}]}, {"glosses": "lone"}], "sounds": {"ipa": "/x/"},
           "synonyms": [{"word": "a", "_dis1": []}, {"word": "b", "_dis1": "1"}, None, "s", {"_dis1": 0}]}
    lines = [(1, json.dumps(rec)), (2, None), (3, ""), (4, "[]"), (5, "null"), (6, '﻿ "' + json.dumps({"sounds": [{"ipa": "y"}]}).replace('"', '\\"') + '" ​'), (7, json.dumps(rec)[:-3]), (8, '{"senses": {"glosses": ["one"]}}'), (9, '{"word": NaN}')]
    d = spark.createDataFrame([(i, x, "clash") for i, x in lines], "line_id BIGINT, line STRING, tbl STRING")
    got = sorted(tuple(r) for r in N.nested_values(d).collect())
    assert got == sorted([(1, "gloss", 1, 0), (1, "gloss", 2, 0), (1, "example", 1, 0), (1, "example", 1, 1), (1, "sound", 0, -1), (1, "synonym", 1, -1), (1, "synonym", 4, -1), (6, "sound", 0, -1), (8, "gloss", 0, 0)])
    assert N.nested_values(d.limit(0)).count() == 0


def test_tables_keep_links(spark, tmp_path):
    d = spark.createDataFrame([(1, '{"word":"w","pos":"n","senses":[{"id":"s1","glosses":["g"],"synonyms":[{"word":"z"}]}],"forms":[{"form":"ws"}]}')], "line_id BIGINT, line STRING")
    p = str(tmp_path / "t")
    N.write_tables(N.tagged_rows(d), p)
    s = N.read_table(spark, p, "sense", "id STRING").collect()
    g = N.read_table(spark, p, "gloss", "x STRING").collect()
    assert s[0].id == "s1" and s[0].parent_pk == "1" and g[0].parent_pk == s[0].pk and g[0].value == "g"
    assert N.read_table(spark, p, "sense_synonym", "word STRING").first().word == "z" and N.read_table(spark, p, "form", "form STRING").first().form == "ws"


def test_any_depth():
    import random

    deep = '{"sounds": [{"ipa": "x", "y": ' + "[" * 200_000 + "]" * 200_000 + '}], "senses": [{"glosses": ["g"]}]}'
    r = N.read_record(deep)
    assert r["sounds"][0]["ipa"] == "x" and r["senses"] == [{"glosses": ["g"]}] and N.read_record(deep[:-1]) is None and N.read_record(deep + "x") is None
    rng = random.Random(3)

    def make(d):
        k = rng.randrange(7 if d else 5)
        if k == 5:
            return [make(d - 1) for _ in range(rng.randrange(3))]
        if k == 6:
            return {f"k{i}": make(d - 1) for i in range(rng.randrange(3))}
        return [None, True, -1.5e3, rng.randrange(99), 'q"\\ü'][k]

    for _ in range(400):
        x = make(4)
        t = json.dumps(x, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        assert N._deep(t) == x
        cut = t[: rng.randrange(len(t))] + rng.choice(["", "]", ",", '"', "}"])
        try:
            exp = json.loads(cut)
        except ValueError:
            exp = None
        assert N._deep(cut) == exp, cut


def test_gloss_links(spark, tmp_path):
    d = spark.createDataFrame([(1, '{"word":"w","senses":[{"id":"s1","glosses":["g",null,"h"]},{"glosses":"k"}]}')], "line_id BIGINT, line STRING")
    d.write.parquet(str(tmp_path / "kaikki_lines.parquet"))
    assert sorted((r.i, r.j, r.sense_id, r.word, r.gloss) for r in N.sense_glosses(spark, str(tmp_path)).collect()) == [(0, 0, "s1", "w", "g"), (0, 2, "s1", "w", "h"), (1, 0, None, "w", "k")]


def test_surrogates_and_long(spark):
    d = spark.createDataFrame([(1, '{"sounds":[{"ipa":"\\ud800x"},{"ipa":"' + "y" * 100_000 + '"}]}'), (2, '{"sounds":[{"ipa":1' + "0" * 6000 + "}]}")], "line_id BIGINT, line STRING")
    assert N.nested_values(d).count() == 3
