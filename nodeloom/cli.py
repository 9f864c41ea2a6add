"""The construction stage by stage: ``python -m nodeloom.cli STAGE --work DIR``; each stage reads and writes tables of DIR.

Stages run in their order and once; ``--reset`` forgets a stage and all after it, ``--force`` runs it regardless, and lets
``leaf_edges`` keep its edges and only re-enter the senses that have none. ``--dry-run`` computes without writing.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.functions import vectors as V
from nodeloom.functions.embed import embed
from nodeloom.operators import matching as M
from nodeloom.options import Options
from nodeloom.plans import build as B
from nodeloom.plans.catalog import neighbourhoods
from nodeloom.plans.stages import STAGES, StageOrderError, StageStore, preflight, run_stage
from nodeloom.runtime import Scratch
from nodeloom.sources.dictionary import parse_lines, read_lines, word_scope
from nodeloom.sources.sinks import write_table


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="nodeloom")
    p.add_argument("stage", choices=[*STAGES, "preflight"])
    p.add_argument("--work", required=True, help="folder of the tables and of the stages' states")
    p.add_argument("--dictionary", default="", help="dictionary lines, for the stage parse")
    p.add_argument("--word-ids-file", default="", help="ids of words whose vectors are to be computed again")
    p.add_argument("--limit", type=int, help="read so many lines or rows only")
    p.add_argument("--batch-size", type=int, default=16, help="texts of one embedding request")
    for flag in ("--reset", "--force", "--dry-run"):
        p.add_argument(flag, action="store_true")
    return p


class Build:
    """The stages' work over the tables of a folder; every stage gives how many rows it made."""

    def __init__(self, spark: SparkSession, args: argparse.Namespace, options: Options):
        self.spark, self.args, self.o = spark, args, options
        self.s = Scratch(spark, "stage")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.args.work}/{name}")

    def has(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.args.work}/{name}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def put(self, name: str, df: DataFrame, mode: str = "overwrite", *by: str) -> int:
        """Write a table from a frame that may read it: what is written is complete before the old one goes."""
        df, c = self.s.cut(df, n=F.count(F.lit(1)))
        if not self.args.dry_run:
            write_table(df, f"{self.args.work}/{name}", *by, mode=mode)
        return c["n"]

    def few(self, df: DataFrame, order: str) -> DataFrame:
        return df if self.args.limit is None else df.orderBy(order).limit(self.args.limit)

    def parse(self, _) -> int:
        w, s = parse_lines(read_lines(self.spark, self.args.dictionary, self.args.limit))
        r = w.select("ord", "word", "pos", F.posexplode("relations").alias("at", "r")).select(F.concat_ws("|", F.format_string("%020d", "ord"), F.format_string("%09d", "at")).alias("row_id"), "word", "pos", "r.kind", F.col("r.word").alias("target"))
        self.put("words", w)
        self.put("relations", r)
        return self.put("senses", s)

    def embed(self, _) -> int:
        s = self.table("senses")
        if self.args.limit is not None:  # whole batches
            s = s.orderBy("ord", "sense_idx").limit(-(-self.args.limit // self.args.batch_size) * self.args.batch_size)
        return self.put("senses_embedded", s.withColumn("vector", embed(F.col("embed_text"), self.o, self.args.batch_size)))

    def nodes(self, _) -> int:
        w, s = B.node_frames(self.table("words"), self.table("senses_embedded"), self.o)
        last = lambda d, *k: d.groupBy(*k).agg(F.max(F.struct("ord", *[c for c in d.columns if c not in (*k, "ord")])).alias("x")).select(*k, "x.*")
        return self.put("word_nodes", last(w, "id")) + self.put("sense_nodes", last(s.drop("parent_edge_id"), "id"))

    def _around(self) -> DataFrame:
        return neighbourhoods(self.table("relations").select("row_id", F.col("word").alias("from_word"), F.col("pos").alias("from_pos"), "kind", F.col("target").alias("word")))

    def leaf_edges(self, _) -> int:
        n = self.few(self.table("sense_nodes"), "id").select("id", "word", "pos", "vec")
        types = B.embedded_types(self.o)
        if self.args.force and self.has("leaf_edges"):
            e = self.table("leaf_edges")
            left = n.join(e.select(F.explode("member_ids").alias("id")), "id", "left_anti")
            return self.put("leaf_edges", B.leaf_reentry(left, e, self._around(), self.o.dim, types), "append")
        return self.put("leaf_edges", B.leaf_stage(self.spark, n, self._around(), self.o.dim, self.o.q_min_leaf, self.o.polysemy_floor, types, self.o.pair_recall or None))

    def _parented(self, nodes: str, *edges: str) -> DataFrame:
        up = None
        for name in edges:
            m = self.table(name).select(F.col("id").alias("parent_edge_id"), F.explode("member_ids").alias("id"))
            up = m if up is None else up.unionByName(m)
        return self.table(nodes).join(up.groupBy("id").agg(F.max("parent_edge_id").alias("parent_edge_id")), "id", "left")

    def word_vectors(self, _) -> int:
        scope = word_scope(self.spark, self.args.word_ids_file) if self.args.word_ids_file else None
        v = B.word_vectors(self.table("word_nodes"), self._parented("sense_nodes", "leaf_edges"), self.table("leaf_edges"), scope)
        if scope is not None and self.has("word_vectors"):
            v, _ = self.s.cut(v)
            v = self.table("word_vectors").join(v.select("id"), "id", "left_anti").unionByName(v)
        return self.put("word_vectors", v)

    def _words(self) -> DataFrame:
        return self.few(self.table("word_nodes").select("id", "word", "pos", "ord"), "ord").join(self.table("word_vectors"), "id")

    def word_edges(self, _) -> int:
        w = self._words()
        matched = M.by_tiers(self.spark, B.tier_pairs(self.spark, B.resolve_targets(w, self.table("relations")), self.o.seeds))
        return self.put("word_edges", B.word_edges(w, matched, B.type_table(self.spark, self.o)))

    def reentry(self, _) -> int:
        e = self.table("word_edges")
        left = self._words().select("id", "vec").join(e.select(F.explode("member_ids").alias("id")), "id", "left_anti")
        return self.put("word_reentry", B.word_reentry(left, e, self.o.dim))

    def _edges(self) -> DataFrame:
        e = [self.table(x).select("id", "vec", F.col("accumulated_weight").alias("w"), "level") for x in ("leaf_edges", "word_edges", "word_reentry")]
        return e[0].unionByName(e[1]).unionByName(e[2])

    def triads(self, _) -> int:
        o = self.o
        return self.put("triads", B.build_levels(self.spark, self._edges(), o.dim, o.triad_cosine, alpha=o.level_alpha, candidates=o.bridge_candidates, recall=o.pair_recall or None))

    def extend(self, _) -> int:
        t = self.table("triads")
        docs = self._edges().unionByName(t.select("id", "vec", F.col("accumulated_weight").alias("w"), "level"))
        more, _ = B.sweep(self.spark, docs, self.o.dim, self.o.triad_cosine, gone=t.select(F.explode("member_ids").alias("id")))
        return self.put("extension", more)

    def layout(self, _) -> int:
        t = self.table("triads").unionByName(self.table("extension"))
        e = self.table("leaf_edges").unionByName(self.table("word_edges"), allowMissingColumns=True).unionByName(self.table("word_reentry"), allowMissingColumns=True)
        e = e.unionByName(t, allowMissingColumns=True).withColumn("doc_type", F.lit("edge"))
        n = self.table("sense_nodes").withColumns({"node_type": F.lit("sense"), "level": F.lit(15), "vec": V.doubles(F.col("vec"))}).drop("relations")
        w = self.table("word_nodes").join(self.table("word_vectors"), "id", "left").withColumns({"node_type": F.lit("word"), "level": F.lit(14)}).drop("relations")
        d = n.unionByName(w, allowMissingColumns=True).withColumn("doc_type", F.lit("node")).unionByName(e, allowMissingColumns=True)
        up = e.select(F.col("id").alias("parent_edge_id"), F.explode("member_ids").alias("id")).groupBy("id").agg(F.max("parent_edge_id").alias("parent_edge_id"))
        return self.put("documents", d.drop("parent_edge_id", "member_ids", "vector").join(up, "id", "left"), "overwrite", "level")


def main(argv: list[str] | None = None, spark: SparkSession | None = None, options: Options | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    spark = spark or SparkSession.builder.appName("nodeloom").getOrCreate()
    if args.stage == "preflight":
        checks = preflight(spark, [args.dictionary] if args.dictionary else [], [args.work])
        for name, ok in checks.items():
            print(f"{'ok' if ok else 'FAILED'}  {name}")
        return 0 if all(checks.values()) else 1
    work: Callable = getattr(Build(spark, args, options or Options.load()), args.stage)
    try:
        n = run_stage(StageStore(f"{args.work}/_stages", spark), args.stage, work, args.force, args.reset, args.dry_run)
    except StageOrderError as e:
        print(e, file=sys.stderr)
        return 1
    print(f"{args.stage}: " + ("done before, see --reset and --force" if n is None else f"{n} rows"))
    return 1 if n is None else 0


if __name__ == "__main__":
    sys.exit(main())
