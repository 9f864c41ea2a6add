"""Incremental ingest of term batches into a graph: new words, merged near-duplicates, new senses of known words.

Terms are taken in order, and a term sees the known senses of its word and the terms before it that became senses. As no
term is a sense of its own exactly if a sense before it is near enough, the outcome is settled in rounds over the pairs of
near terms of one word: a term near a known sense, or near an earlier term that became a sense, is merged; a term all of
whose earlier near terms are merged becomes a sense. Pairs are found within words by equi-joins, in tiles for words with
many terms, so no word is ever worked through in one task, and the rounds go over near pairs only.

Defined results: terms without vector are new senses; a word known under several parts of speech takes the one whose
vector (or mean of its known senses) is nearest, the first if none has one; unknown words become nouns, their first term
a new word; a merged term joins the nearest sense, of equal ones a known one, then the first.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from nodeloom.functions import vectors as V
from nodeloom.functions.embed import embed
from nodeloom.operators.simjoin import pairs_within
from nodeloom.options import Options
from nodeloom.runtime import Scratch
from nodeloom.sources.terms import dedupe

INGESTED = "sense_id STRING, word STRING, pos STRING, gloss STRING, dois ARRAY<STRING>, outcome STRING, merged_into STRING, vec ARRAY<DOUBLE>"
#: Copies of a word's parts of speech that the terms of a much used word are spread over.
SALTS = 8


def _with_pos(t: DataFrame, words: DataFrame, senses: DataFrame) -> DataFrame:
    """``t`` with ``pos`` and whether its word was known (``old``)."""
    w = words.filter("word IS NOT NULL AND pos IS NOT NULL").select("word", "pos", F.col("ord").cast("bigint").alias("o"), V.doubles(F.col("vec")).alias("v"))
    w = w.groupBy("word", "pos").agg(F.min("o").alias("o"), F.min("v").alias("v"))
    s = senses.filter("word IS NOT NULL AND pos IS NOT NULL").groupBy("word", "pos").agg(V.vector_sum(F.col("vec")).alias("m"), F.count("vec").alias("n"))
    c = w.join(s, ["word", "pos"], "full").select("word", "pos", F.coalesce("o", F.lit(2**62)).alias("o"), F.coalesce("v", F.when(F.col("n") > 0, F.col("m"))).alias("v"))
    c = c.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    j = t.withColumn("salt", F.pmod(F.xxhash64("ord"), F.lit(SALTS))).join(c, ["word", "salt"], "left").withColumn("near", V.cosine(F.col("vec"), F.col("v")))
    best = F.row_number().over(W.partitionBy("ord").orderBy(F.col("near").desc_nulls_last(), "o", "pos"))
    j = j.withColumn("_r", best).filter("_r = 1")
    return j.withColumn("old", F.col("pos").isNotNull()).withColumn("pos", F.coalesce("pos", F.lit("noun"))).select(*t.columns, "pos", "old")


def ingest(spark: SparkSession, terms: DataFrame, words: DataFrame, senses: DataFrame, dim: int, options: Options | None = None) -> DataFrame:
    """What becomes of each different term of (ord, doi, term_id, term, norm_term, gloss, sense_id): ``outcome`` new_word,
    new_sense or merged (into ``merged_into``). words: (word, pos, ord, vec); senses: (id, word, pos, vec)."""
    o = replace(options or Options.load(), dim=dim)
    t = dedupe(terms).withColumn("vec", V.doubles(embed(F.col("gloss"), o))).withColumnRenamed("term", "word")
    return settle(spark, t.select("ord", "word", "sense_id", "gloss", "dois", "vec"), words, senses, dim, o.near_duplicate)


def settle(spark: SparkSession, terms: DataFrame, words: DataFrame, senses: DataFrame, dim: int, threshold: float) -> DataFrame:
    """``ingest`` of terms (ord, word, sense_id, gloss, dois, vec) that have their vectors; ord is unique."""
    s = Scratch(spark, "ingest")
    t, _ = s.cut(_with_pos(terms.filter(F.col("word").isNotNull()), words, senses))
    known = senses.filter("id IS NOT NULL").join(t.select("word").distinct(), "word", "left_semi").groupBy("id", "word", "pos").agg(F.min(V.doubles(F.col("vec"))).alias("vec"))
    key = F.concat(F.lit("t"), F.format_string("%020d", F.col("ord").cast("bigint")))  # known senses come first in order: k < t
    both = known.select("word", "pos", F.concat(F.lit("k"), "id").alias("id"), "vec").unionByName(t.select("word", "pos", key.alias("id"), "vec"))
    near = pairs_within(both, ["word", "pos"], dim, threshold).filter(F.col("b").startswith("t")).select(F.col("a").alias("early"), F.col("b").alias("late"), "score")
    near, c = s.cut(near, n=F.count(F.lit(1)))
    open_, left, kept = near, c["n"], None
    merged = None
    while left:
        into = open_.filter(F.col("early").startswith("k")).select("late")
        if kept is not None:
            into = into.unionByName(open_.join(kept.select(F.col("id").alias("early")), "early", "left_semi").select("late"))
        out, _ = s.cut(into.distinct())
        merged = out if merged is None else merged.unionByName(out)
        rest = open_.join(out, "late", "left_anti").join(out.select(F.col("late").alias("early")), "early", "left_anti")
        rest, d = s.cut(rest, n=F.count(F.lit(1)))
        if open_ is not near:
            s.drop(open_)
        # terms that no open pair comes before are senses
        kept = rest.select(F.col("early").alias("id")).distinct().join(rest.select(F.col("late").alias("id")), "id", "left_anti")
        kept, _ = s.cut(kept)
        open_, left = rest, d["n"]
    t = t.withColumn("key", key)
    if merged is not None:
        m = merged.select(F.col("late").alias("key")).distinct().withColumn("is_merged", F.lit(True))
        target = near.join(merged.select(F.col("late").alias("early")).distinct(), "early", "left_anti").groupBy(F.col("late").alias("key"))
        target = target.agg(F.min(F.struct(-F.round("score", 12), "early")).alias("m")).select("key", F.col("m.early").alias("to"))
        names = t.select(F.col("key").alias("to"), F.col("sense_id").alias("to_sense"))
        t = t.join(m, "key", "left").join(target, "key", "left").join(names, "to", "left")
    else:
        t = t.withColumns({"is_merged": F.lit(None).cast("boolean"), "to": F.lit(None).cast("string"), "to_sense": F.lit(None).cast("string")})
    is_merged = F.coalesce("is_merged", F.lit(False))
    first = t.filter(~F.col("old")).groupBy("word").agg(F.min("ord").alias("first"))
    t = t.join(first, "word", "left")
    outcome = F.when(is_merged, "merged").when(F.col("ord") == F.col("first"), "new_word").otherwise("new_sense")
    into = F.when(is_merged, F.when(F.col("to").startswith("k"), F.expr("substring(to, 2)")).otherwise(F.col("to_sense")))
    return t.select("sense_id", "word", "pos", "gloss", "dois", outcome.alias("outcome"), into.alias("merged_into"), "vec")


def outcome_counts(ingested: DataFrame) -> DataFrame:
    return ingested.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def touched_words(ingested: DataFrame) -> DataFrame:
    """(word, pos) of the words that a batch made or gave a sense: the scope of the next recomputation of vectors."""
    return ingested.filter("outcome <> 'merged'").select("word", "pos").distinct()
