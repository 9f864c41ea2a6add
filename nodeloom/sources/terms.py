"""Term batches: JSONL records {doi, terms: [...]} or {doi, extracted: {doi, terms: [...]}}, any number of files.

The outer identifier holds for all terms of a record; terms without term, gloss or id are skipped, as are damaged lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.functions import text as X

_TERMS = "ARRAY<STRUCT<id: STRING, term: STRING, gloss: STRING>>"
SCHEMA = f"doi STRING, cost_usd DOUBLE, duration_ms BIGINT, terms {_TERMS}, extracted STRUCT<doi: STRING, terms: {_TERMS}>"


def read_terms(spark: SparkSession, *paths: str) -> DataFrame:
    """Term rows of JSONL files; a directory or pattern reads all its files."""
    r = spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(list(paths))
    t = r.select("doi", F.posexplode(F.coalesce(F.when(F.col("extracted").isNotNull(), F.col("extracted.terms")), F.col("terms"))).alias("at", "t"))
    return term_rows(t.select(F.monotonically_increasing_id().alias("ord"), "doi", F.col("t.id").alias("term_id"), F.col("t.term").alias("term"), F.col("t.gloss").alias("gloss")))


def term_rows(terms: DataFrame) -> DataFrame:
    """(ord, doi, term_id, term, gloss) completed: raw ``term`` kept, ``norm_term`` for comparing, ``sense_id``."""
    ok = terms.filter((F.trim("term") != "") & (F.trim("gloss") != "") & (F.trim("term_id") != ""))
    t = ok.withColumn("doi", X.normalize_doi(F.col("doi")))
    return t.withColumn("norm_term", X.normalize_term(F.col("term"))).withColumn("sense_id", X.term_sense_id(F.col("doi"), F.col("term_id"), F.col("gloss")))


def dedupe(terms: DataFrame) -> DataFrame:
    """First occurrence per (norm_term, gloss) with the sorted identifiers of all of them in ``dois``."""
    g = terms.groupBy("norm_term", "gloss").agg(F.min(F.struct("ord", "term", "term_id", "sense_id")).alias("s"), F.array_sort(F.collect_set("doi")).alias("dois"))
    return g.select("s.ord", "s.term", "norm_term", "gloss", "s.term_id", "s.sense_id", "dois")
