"""Session-level helpers shared by all operators: table access, lineage cuts, skew-safe lookups."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of stored input that one shuffle partition is meant for, and the most partitions.
SHUFFLE_BYTES, MOST_PARTITIONS = 16 << 20, 100_000
_SIZED: dict[str, str] = {}


def size_shuffles(spark: SparkSession, data_dir: str) -> None:
    """Set the number of shuffle partitions by the bytes of the data and the cores, unless the user has set one.

    Small data then pay for few files a task, large data get partitions that fit an executor; adaptive execution may
    still join small ones."""
    key, app = "spark.sql.shuffle.partitions", spark.sparkContext.applicationId
    now = spark.conf.get(key)
    if now != _SIZED.get(app) and (spark.sparkContext.getConf().contains(key) or now != "200"):
        return
    p = spark._jvm.org.apache.hadoop.fs.Path(data_dir)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return
    size = fs.getContentSummary(p).getLength()
    n = str(min(MOST_PARTITIONS, max(2 * spark.sparkContext.defaultParallelism, -(-size // SHUFFLE_BYTES))))
    spark.conf.set(key, n)
    _SIZED[app] = n


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``. Only a local session may do without: it gets a folder
    of its own, as all its tasks run on this machine; elsewhere a missing setting is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), f"nodeloom-{spark.sparkContext.applicationId}")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Written tables of one iterative operator.

    ``cut`` materialises a frame as parquet in the shared folder and reads it back, so the lineage ends there and a
    lost executor costs a re-read only. Tables of earlier rounds are dropped with ``drop`` once they are superseded;
    whatever the result still reads stays until the application's folder is cleaned.

    A table belongs to the frame that ``cut`` gave back, which is held here as long as its table stands, so no other
    frame can be taken for it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.n = spark, 0
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.tables: list[tuple[DataFrame, str]] = []

    def cut(self, df: DataFrame, **counts) -> tuple[DataFrame, dict]:
        """Write ``df`` and return it re-read, with the named aggregates observed while it was written."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        if counts:
            seen = Observation(f"{os.path.basename(self.root)}-{self.n}")
            df = df.observe(seen, *[c.alias(k) for k, c in counts.items()])
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((back, path))
        return back, (seen.get if counts else {})

    def drop(self, *frames: DataFrame) -> None:
        """Delete the written tables of frames that ``cut`` gave back; any other frame is an error."""
        for f in frames:
            at = next((i for i, (own, _) in enumerate(self.tables) if own is f), None)
            if at is None:
                raise ValueError("not a written table")
            delete(self.spark, self.tables.pop(at)[1])


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of any file system Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def count_where(cond) -> F.Column:
    """Number of rows that meet ``cond`` (0 over no rows)."""
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0))
