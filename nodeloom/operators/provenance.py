"""Provenance as a two-column table (doi, node_id) with set semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.operators.graph import ancestors


def register(prov: DataFrame | None, nodes: DataFrame, node: str = "id", doi: str = "doi") -> DataFrame:
    """Add every (doi, node) of array column ``doi``; blank and null identifiers are none."""
    new = nodes.select(F.explode(doi).alias("doi"), F.col(node).alias("node_id")).filter(F.col("doi").isNotNull() & (F.trim("doi") != "") & F.col("node_id").isNotNull())
    return (new if prov is None else prov.select("doi", "node_id").unionByName(new)).distinct()


def propagate(prov: DataFrame, made: DataFrame) -> DataFrame:
    """Give each new document of (new_id, part_id) the identifiers of its parts."""
    up = made.join(prov, made.part_id == prov.node_id).select("doi", F.col("new_id").alias("node_id"))
    return prov.select("doi", "node_id").unionByName(up).distinct()


def propagate_up_chain(spark: SparkSession, prov: DataFrame, graph: DataFrame, leaves: DataFrame, max_levels: int | None = None) -> DataFrame:
    """Give every ancestor of the leaves of (id), up to the roots or ``max_levels``, the leaf's identifiers; loops are walked
    once."""
    up = ancestors(spark, graph, leaves.select("id").distinct(), max_levels)
    new = up.join(prov, up.start == prov.node_id).select("doi", F.col("id").alias("node_id"))
    return prov.select("doi", "node_id").unionByName(new).distinct()


def dois_of(prov: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, dois) for the asked ids that have any."""
    return ids.select("id").distinct().join(prov, F.col("id") == F.col("node_id")).groupBy("id").agg(F.array_sort(F.collect_set("doi")).alias("dois"))
