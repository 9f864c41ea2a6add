"""Sinks: atomically committed tables and JSON, ids of inserted rows, physical layout for lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.plans.build import made_id


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, visible only once the job has committed."""
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, *partitions: str, mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partitions) if partitions else w).parquet(path)


def insert(df: DataFrame, path: str, *key: str) -> DataFrame:
    """Append rows under ids made of ``key`` and return the inserted ids."""
    d = df.withColumn("id", made_id(*key))
    d.write.mode("append").parquet(path)
    return d.select("id")


def write_touched(ids: DataFrame, path: str) -> None:
    """The different ids of (id), as a word scope reads them back."""
    ids.select("id").filter("id IS NOT NULL").distinct().write.mode("overwrite").json(path)


def layout(spark: SparkSession, docs: DataFrame, name: str, buckets: int = 64) -> None:
    """The document table laid out for lookups: partitioned by level, bucketed and sorted by id, so joins on ids of this
    and equally bucketed tables need no shuffle. Replaces an earlier one."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    docs.write.partitionBy("level").bucketBy(buckets, "id").sortBy("id").format("parquet").saveAsTable(name)


def read_holdout(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("word_a STRING, gloss_a STRING, word_b STRING").option("multiLine", True).json(path)


def exists(df: DataFrame) -> bool:
    """Whether there is a row, read up to the first."""
    return not df.select(F.lit(1)).limit(1).isEmpty()
