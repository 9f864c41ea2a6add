"""Evaluation: held-out synonym pairs and recall of graph search against flat search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.operators import graph as G
from nodeloom.operators.simjoin import nearest
from nodeloom.operators.relational import recall_at_k, seeded_order, unordered_pairs


def holdout(relations: DataFrame, words: DataFrame, senses: DataFrame, fraction: float, seed: int = 13) -> DataFrame:
    """(word_a, gloss_a, word_b): max(1, round(n fraction)) different synonym pairs of known words, drawn by a seeded
    hash, each with the first gloss of word_a or else the word itself."""
    known = words.filter("word IS NOT NULL").select("word").distinct()
    p = unordered_pairs(relations.filter("kind = 'synonyms'"), "from_word", "word")
    p = p.join(known.withColumnRenamed("word", "a"), "a", "left_semi").join(known.withColumnRenamed("word", "b"), "b", "left_semi")
    n = p.count()
    p = p.orderBy(*seeded_order(seed, "a", "b")).limit(max(1, round(n * fraction)))
    g = senses.filter("gloss <> ''").groupBy(F.col("word").alias("a")).agg(F.min_by("gloss", "row_id").alias("g"))
    return p.join(g, "a", "left").select(F.col("a").alias("word_a"), F.coalesce("g", "a").alias("gloss_a"), F.col("b").alias("word_b"))


def graph_recall(spark: SparkSession, graph: DataFrame, edge_hits: DataFrame, node_hits: DataFrame, pairs: DataFrame) -> DataFrame:
    """Recall of edge hits (pair, id) that have word_b among their leaves, and of node hits (pair, id) whose word it is.

    pairs: (pair, word_b). Gives (method, recall, n)."""
    t = edge_hits.join(pairs, "pair").select(F.col("pair").alias("start"), "id", F.col("word_b").alias("target"))
    found = G.any_leaf_has_word(spark, graph, t).select(F.col("start").alias("pair")).distinct().withColumn("hit", F.lit(True))
    w = graph.filter("doc_type = 'node'").select("id", "word")
    flat = node_hits.join(w, "id").join(pairs, "pair").filter("word = word_b").select("pair").distinct().withColumn("hit", F.lit(True))

    def of(name: str, hits: DataFrame) -> DataFrame:
        return pairs.select("pair").distinct().join(hits, "pair", "left").select(F.lit(name).alias("method"), "pair", F.coalesce("hit", F.lit(False)).alias("hit"))

    return recall_at_k(of("graph", found).unionByName(of("flat", flat)))


def search_recall(spark: SparkSession, graph: DataFrame, vectors: DataFrame, pairs: DataFrame, queries: DataFrame, dim: int, k: int = 20) -> DataFrame:
    """``graph_recall`` of the k nearest edges and the k nearest nodes of levels 14 and 15 to each query vector (pair, vec)."""
    q = queries.select(F.col("pair").alias("id"), "vec")
    v = vectors.join(graph.select("id", "doc_type", "level"), "id")
    kinds = v.filter("doc_type <> 'node'"), v.filter("doc_type = 'node' AND level IN (14, 15)")
    edges, nodes = (nearest(q, x.select("id", "vec"), dim, k).select(F.col("id").alias("pair"), F.col("match").alias("id")) for x in kinds)
    return graph_recall(spark, graph, edges, nodes, pairs)
