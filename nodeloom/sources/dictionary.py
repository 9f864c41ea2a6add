"""Dictionary lines to word and sense rows, by Spark's own JSON reader with one declared schema.

Accepted are English records (a missing language counts as English) with word and part of speech and at least one sense
whose first gloss is not empty; damaged lines are skipped. ``limit`` counts raw lines, rejected ones too. A sense keeps
its position in the record. For records whose shape varies see ``operators.nested``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.functions import text as X
from nodeloom.operators.nested import RELATIONS

_REL = "ARRAY<STRUCT<word: STRING, _dis1: STRING>>"
_RELS = ", ".join(f"{r}: {_REL}" for r in RELATIONS)
SCHEMA = (
    "word STRING, pos STRING, lang_code STRING, etymology_text STRING, "
    "sounds ARRAY<STRUCT<ipa: STRING, tags: ARRAY<STRING>>>, forms ARRAY<STRUCT<form: STRING, tags: ARRAY<STRING>>>, "
    "senses ARRAY<STRUCT<id: STRING, glosses: ARRAY<STRING>, examples: ARRAY<STRUCT<text: STRING>>, tags: ARRAY<STRING>, "
    f"topics: ARRAY<STRING>, wikidata: ARRAY<STRING>, {_RELS}>>, " + ", ".join(f"{r} {_REL}" for r in RELATIONS)
)


def read_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(ord, value) of the lines of JSONL files, in no particular order unless ``limit`` is given."""
    t = spark.read.text(path)
    if limit is None:
        return t.select(F.monotonically_increasing_id().alias("ord"), "value")
    # the first lines of the files in order of their names
    at = t.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("ord"), "value")
    return at.orderBy("f", "b", "ord").limit(limit).select("ord", "value")


def parse_lines(lines: DataFrame, lang: str = "en") -> tuple[DataFrame, DataFrame]:
    """(words, senses) of (ord, value). Words: ord, word, pos, lang_code, ipa, forms, etymology, sense_ids, relations;
    senses: ord, word, pos, sense_id, sense_idx, gloss, examples, tags, topics, wikidata, relations, embed_text."""
    r = lines.select("ord", F.from_json("value", SCHEMA).alias("r")).select("ord", "r.*")
    r = r.filter((F.col("word") != "") & (F.col("pos") != "") & (F.coalesce("lang_code", F.lit("en")) == lang))
    none = F.array().cast("array<string>")
    good = F.filter(F.transform("senses", lambda s, i: F.struct(i.alias("idx"), s.alias("s"))), lambda x: F.coalesce(F.get(x["s"]["glosses"], F.lit(0)) != "", F.lit(False)))
    r = r.withColumn("good", good).filter(F.size("good") > 0)
    ids = F.transform("good", lambda x: X.sense_id(x["s"]["id"], F.col("word"), F.col("pos"), x["idx"]))
    words = r.select("ord", "word", "pos", F.coalesce("lang_code", F.lit("en")).alias("lang_code"), X.first_ipa(F.col("sounds")).alias("ipa"),
                     F.coalesce(X.form_list(F.col("forms")), none).alias("forms"), F.col("etymology_text").alias("etymology"), ids.alias("sense_ids"),
                     X.relation_list({k: F.col(k) for k in RELATIONS}).alias("relations"))
    s = r.select("ord", "word", "pos", F.explode("good").alias("g")).select("ord", "word", "pos", F.col("g.idx").alias("sense_idx"), "g.s.*")
    s = s.withColumn("gloss", F.col("glosses")[0]).withColumn("ex", F.filter(F.transform("examples", lambda e: e["text"]), lambda t: t.isNotNull() & (t != "")))
    senses = s.select("ord", "word", "pos", X.sense_id(F.col("id"), F.col("word"), F.col("pos"), F.col("sense_idx")).alias("sense_id"), "sense_idx", "gloss",
                      F.coalesce("ex", none).alias("examples"), F.coalesce("tags", none).alias("tags"), F.coalesce("topics", none).alias("topics"), F.coalesce("wikidata", none).alias("wikidata"),
                      X.relation_list({k: F.col(k) for k in RELATIONS}).alias("relations"), X.embed_text(F.col("gloss"), F.col("ex")).alias("embed_text"))
    return words, senses


def fixture_lines(lines: DataFrame, words: list[str], lang: str = "en") -> DataFrame:
    """The raw lines of the given words in one language."""
    w, l = F.get_json_object("value", "$.word"), F.get_json_object("value", "$.lang_code")
    return lines.filter(w.isin(words) & (l == lang))


def word_scope(spark: SparkSession, path: str) -> DataFrame:
    """(id) of a file or folder of ids: JSON lists of ids, or lines {"id": ...} as the ingest's sink writes them."""
    t = spark.read.text(path).select(F.trim("value").alias("v"))
    ids = F.when(F.col("v").startswith("["), F.from_json("v", "array<string>")).otherwise(F.array(F.get_json_object("v", "$.id")))
    return t.select(F.explode(ids).alias("id")).filter("id IS NOT NULL").distinct()


def resume_after(df: DataFrame, key: str, last: str | int | None) -> DataFrame:
    """The rows behind the last processed key."""
    return df if last is None else df.filter(F.col(key) > F.lit(last))
