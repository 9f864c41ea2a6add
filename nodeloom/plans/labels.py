"""Label jobs: requests for triads without label, answers read back, guarded writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.functions import text as X
from nodeloom.operators.graph import triad_view
from nodeloom.operators.relational import page

SYSTEM = "Name the concept that joins the word groups. Answer with JSON {\"semantic_label\": \"...\"}."
ANSWER = "key STRING, status STRUCT<code: INT, message: STRING>, response STRUCT<candidates: ARRAY<STRUCT<content: STRUCT<parts: ARRAY<STRUCT<text: STRING>>>>>>"


def unlabelled(graph: DataFrame, level: int, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the triads of a level that have no label, in order of id."""
    t = graph.filter((F.col("doc_type") != "node") & (F.col("level") == level) & (F.col("level") <= 13))
    if "semantic_label" in graph.columns:
        t = t.filter("semantic_label IS NULL")
    return page(t, "id", limit, offset)


def requests(spark: SparkSession, graph: DataFrame, ids: DataFrame, temperature: float = 0.2, penalty: float = 0.0, most_tokens: int = 1024, thinking: int = 0) -> DataFrame:
    """(key, request) per triad: the first ten words of each branch and the strength with three decimals, as JSON."""
    v = triad_view(spark, graph, ids, cap=10).groupBy("id").agg(*[F.max(F.when(F.col("branch") == b, X.first_words(F.col("words")))).alias(b) for b in ("child1", "child2", "bridge")])
    t = ids.select("id").join(graph.select("id", "level", "connection_strength"), "id").join(v, "id", "left")
    none = F.lit("")
    text = F.format_string("level %d, strength %.3f\nA: %s\nB: %s\nbridge: %s", "level", F.coalesce("connection_strength", F.lit(0.0)), F.coalesce("child1", none), F.coalesce("child2", none), F.coalesce("bridge", none))
    body = F.struct(
        F.struct(F.lit("system").alias("role"), F.array(F.struct(F.lit(SYSTEM).alias("text"))).alias("parts")).alias("system_instruction"),
        F.array(F.struct(F.lit("user").alias("role"), F.array(F.struct(text.alias("text"))).alias("parts"))).alias("contents"),
        F.struct(F.lit("application/json").alias("responseMimeType"), F.lit(most_tokens).alias("maxOutputTokens"), F.lit(temperature).alias("temperature"),
                 F.lit(penalty).alias("frequencyPenalty"), F.struct(F.lit(thinking).alias("thinkingBudget")).alias("thinkingConfig")).alias("generationConfig"),
    )
    return t.select(F.col("id").alias("key"), F.to_json(F.struct(F.col("id").alias("key"), body.alias("request"))).alias("line"))


def answers(spark: SparkSession, path: str) -> DataFrame:
    """(id, semantic_label) of answer lines without error whose first candidate holds a label of 3 to 200 characters."""
    r = spark.read.schema(ANSWER).option("mode", "DROPMALFORMED").json(path)
    ok = r.filter(F.coalesce(F.col("status.code"), F.lit(0)) == 0)
    text = F.get(F.get("response.candidates", F.lit(0))["content"]["parts"], F.lit(0))["text"]
    return ok.select(F.col("key").alias("id"), X.semantic_label(text).alias("semantic_label")).filter("semantic_label IS NOT NULL AND id IS NOT NULL")
