"""Ingest of a growing directory of term batches as a stream of micro-batches with idempotent writes.

The target is a table in ``BUCKETS`` buckets by the hash of the key. A micro-batch writes only the buckets it touches, as
the version of its number (``v=3/bucket=17``), from what they held before it; a batch that is run again after a failure
writes the same files again. The newest version of each bucket is the table; what a batch supersedes is removed by the
batch after it, which no repetition needs any more.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nodeloom.operators.relational import last_wins, upsert
from nodeloom.options import Options
from nodeloom.plans.ingest import ingest
from nodeloom.runtime import delete
from nodeloom.sources.terms import SCHEMA, term_rows

BUCKETS = 64


def stream_terms(spark: SparkSession, directory: str, files_per_batch: int = 100) -> DataFrame:
    """Raw term records of new files."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(directory)


def explode_terms(records: DataFrame) -> DataFrame:
    t = records.select("doi", F.explode(F.coalesce(F.when(F.col("extracted").isNotNull(), F.col("extracted.terms")), F.col("terms"))).alias("t"))
    return t.select("doi", F.col("t.id").alias("term_id"), F.col("t.term").alias("term"), F.col("t.gloss").alias("gloss"))


def _versions(spark: SparkSession, target: str, before: int | None = None) -> dict[int, list[int]]:
    """The versions of each bucket, oldest first; of those below ``before`` if given."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{target}/v=*/bucket=*")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    out: dict[int, list[int]] = {}
    for f in found:
        v, b = map(int, re.search(r"v=(\d+)/bucket=(\d+)$", f.getPath().toString()).groups())
        if before is None or v < before:
            out.setdefault(b, []).append(v)
    return {b: sorted(v) for b, v in out.items()}


def current(spark: SparkSession, target: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The table, as it is or as it was before a batch, or some buckets of it; None if there is none."""
    paths = [f"{target}/v={v[-1]}/bucket={b}" for b, v in sorted(_versions(spark, target, before).items()) if buckets is None or b in buckets]
    return spark.read.parquet(*paths) if paths else None


def write_batch(rows: DataFrame, number: int, target: str, key: str) -> None:
    """Upsert ``rows`` (one per key) into the buckets they fall into, as version ``number``."""
    spark = rows.sparkSession
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")).persist()
    try:
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most BUCKETS
        old = current(spark, target, number, touched)
        if old is not None:
            new = upsert(old.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")), rows, [key])
        else:
            new = rows
        new.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/v={number}")
    finally:
        rows.unpersist()
    for b, v in _versions(spark, target, number).items():
        for gone in v[:-1]:
            delete(spark, f"{target}/v={gone}/bucket={b}")


def ingest_stream(records: DataFrame, target: str, checkpoint: str, apply: Callable[[DataFrame, int], DataFrame] | None = None) -> StreamingQuery:
    """Each micro-batch's terms, worked on by ``apply`` (by default the last of each sense id), upserted by sense id."""

    def one(batch: DataFrame, number: int) -> None:
        rows = term_rows(explode_terms(batch).withColumn("ord", F.monotonically_increasing_id()))
        rows = last_wins(rows, ["sense_id"], "ord") if apply is None else apply(rows, number)
        write_batch(rows, number, target, "sense_id")

    return records.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _ingested(rows: DataFrame, number: int, target: str, words: DataFrame, senses: DataFrame, dim: int, options: Options | None) -> DataFrame:
    spark = rows.sparkSession
    before = current(spark, target, number)
    if before is not None:
        own = before.filter("outcome <> 'merged'")
        senses = senses.unionByName(own.select(F.col("sense_id").alias("id"), "word", "pos", "vec"))
        made = own.filter("outcome = 'new_word'").select("word", "pos", F.lit(2**61).alias("ord"), F.lit(None).cast("array<double>").alias("vec"))
        words = words.select("word", "pos", F.col("ord").cast("bigint").alias("ord"), "vec").unionByName(made)
        rows = rows.join(before.select("sense_id"), "sense_id", "left_anti")
    return ingest(spark, rows, words, senses, dim, options)


def ingest_graph_stream(records: DataFrame, target: str, checkpoint: str, words: DataFrame, senses: DataFrame, dim: int, options: Options | None = None) -> StreamingQuery:
    """The ingest of ``plans.ingest`` batch by batch: terms see the graph's senses and those of earlier batches; terms that
    were ingested before are left alone. The target holds every term with its outcome."""
    return ingest_stream(records, target, checkpoint, partial(_ingested, target=target, words=words, senses=senses, dim=dim, options=options))
