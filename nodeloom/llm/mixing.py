"""Mixing sources to target weights by capped water-filling and seeded whole and fractional repetition.

Sizes are tokens of a public tokenizer. A source asked for more than its size times its repeat cap is clamped there and
the excess goes to the others in proportion to their targets, until every source is feasible. Each document of a source
with e epochs occurs floor(e) times, and once more if it lies below the source's cut in a seeded hash order; the cut is
found from two levels of 4096 hash cells and the documents of one cell, so the drawn size is short of the wanted one by
less than one document and no source is ever sorted or held as a whole.

Defined results: sources that are null or have no target are not drawn and are reported with share 0; a target without
documents is reported with drawn size 0 and its share goes to the others; documents of no tokens follow their source's
whole repetitions; repeated rows each count; an empty table draws nothing; a null or negative target counts as 0, a null
cap as 0 repeats; shares are scaled to sum 1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from nodeloom.llm.encode import token_counts
from nodeloom.runtime import Scratch, table

#: Rows that the table of targets may have, as it is held by the driver; a larger one is refused.
MOST_TARGETS = 10_000
_CELLS = 12


@dataclass
class Share:
    source: str
    target: float
    cap: int
    size: int
    wanted: float = 0.0

    @property
    def epochs(self) -> float:
        return min(self.wanted / self.size, self.cap) if self.size else 0.0

    @property
    def whole(self) -> int:
        return int(self.epochs + 1e-12)

    @property
    def rest(self) -> int:
        """Tokens wanted beyond the whole repetitions."""
        return max(0, int(round(self.wanted - self.whole * self.size)))


def water_fill(shares: list[Share], total: float) -> list[Share]:
    """Set ``wanted`` so that it sums to ``total`` as far as the caps allow, in proportion to the targets."""
    open_ = [s for s in shares if s.target > 0 and s.size * s.cap > 0]
    left = float(total)
    for s in shares:
        s.wanted = 0.0
    while open_ and left > 0:
        weight = sum(s.target for s in open_)
        full = [s for s in open_ if left * s.target / weight >= s.size * s.cap]
        if not full:
            for s in open_:
                s.wanted = left * s.target / weight
            break
        for s in full:
            s.wanted = float(s.size * s.cap)
            left -= s.wanted
        open_ = [s for s in open_ if s not in full]
    return shares


def allotment(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> list[Share]:
    """Water-filled shares of the target sources, from per-source totals aggregated in the cluster."""
    want = targets.groupBy("source").agg(F.max("target_share").alias("t"), F.max("max_repeats").alias("c")).filter(F.col("source").isNotNull())
    rows = want.limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    have = sizes.join(F.broadcast(want.select("source")), "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("n"))
    size = {r["source"]: r["n"] or 0 for r in have.collect()}
    sum_t = sum(max(0.0, r["t"] or 0.0) for r in rows) or 1.0
    shares = [Share(r["source"], max(0.0, r["t"] or 0.0) / sum_t, max(0, r["c"] or 0), size.get(r["source"], 0)) for r in rows]
    shares.sort(key=lambda s: s.source)
    return water_fill(shares, sum(s.size for s in shares) if total is None else total)


def _plan(spark: SparkSession, shares: list[Share]) -> DataFrame:
    kind = T.StructType([T.StructField("source", T.StringType()), T.StructField("whole", T.LongType()), T.StructField("rest", T.LongType())])
    return spark.createDataFrame([(s.source, s.whole, s.rest) for s in shares], kind)


def draw(spark: SparkSession, sizes: DataFrame, shares: list[Share], seed: int = 42) -> DataFrame:
    """(doc_id, source, tokens, copies) of every drawn document; ``sizes`` has doc_id, source and tokens."""
    plan = F.broadcast(_plan(spark, shares))
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 64 - 2 * _CELLS)
    d = sizes.join(plan, "source").withColumn("c1", F.shiftright(h, _CELLS)).withColumn("c2", h.bitwiseAND(F.lit((1 << _CELLS) - 1)))

    def cut(x: DataFrame, cell: str, rest: str) -> DataFrame:
        """Per source the cell in which the running size passes ``rest`` and what is wanted of it."""
        run = W.partitionBy("source").orderBy(cell).rowsBetween(W.unboundedPreceding, W.currentRow)
        s = x.groupBy("source", cell).agg(F.sum("tokens").alias("n"), F.first(rest).alias("r")).withColumn("upto", F.sum("n").over(run))
        return s.filter(F.col("upto") > F.col("r")).groupBy("source").agg(F.min(F.struct(cell, (F.col("r") - F.col("upto") + F.col("n")).alias("r"))).alias("k"))

    k1 = F.broadcast(cut(d, "c1", "rest").select("source", F.col("k.c1").alias("k1"), F.col("k.r").alias("r1")))
    d = d.join(k1, "source", "left")
    inner = d.filter(F.col("c1") == F.col("k1"))
    k2 = F.broadcast(cut(inner, "c2", "r1").select("source", F.col("k.c2").alias("k2"), F.col("k.r").alias("r2")))
    d = d.join(k2, "source", "left")
    cell = (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2"))
    last = d.filter(F.coalesce(cell, F.lit(False)))
    run = W.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = last.withColumn("more", (F.sum("tokens").over(run) <= F.col("r2")))
    others = d.filter(~F.coalesce(cell, F.lit(False)))
    below = F.col("k1").isNull() | (F.col("c1") < F.col("k1")) | ((F.col("c1") == F.col("k1")) & (F.col("k2").isNull() | (F.col("c2") < F.col("k2"))))
    others = others.withColumn("more", below)
    both = last.select("doc_id", "source", "tokens", "whole", "rest", "more").unionByName(others.select("doc_id", "source", "tokens", "whole", "rest", "more"))
    both = both.withColumn("copies", F.col("whole") + F.when(F.col("more") & (F.col("rest") > 0), 1).otherwise(0))
    return both.filter(F.col("copies") > 0).select("doc_id", "source", "tokens", F.col("copies").cast("int"))


def report(spark: SparkSession, sizes: DataFrame, drawn: DataFrame, shares: list[Share]) -> DataFrame:
    """Per source: target, available and drawn tokens, reached share, epochs and whether the cap held it back."""
    kind = "source STRING, target_share DOUBLE, max_repeats INT, epochs DOUBLE, capped BOOLEAN"
    plan = spark.createDataFrame([(s.source, s.target, s.cap, s.epochs, bool(s.size) and s.wanted >= s.size * s.cap) for s in shares], kind)
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("available"), F.count(F.lit(1)).alias("documents"))
    got = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn"), F.max("copies").alias("most_copies"))
    j = have.join(plan, have.source.eqNullSafe(plan.source), "full").select(F.coalesce(have.source, plan.source).alias("source"), "target_share", "max_repeats", "epochs", "capped", "available", "documents")
    j = j.join(got.withColumnRenamed("source", "_s"), F.col("source") == F.col("_s"), "left").drop("_s")
    total = got.agg(F.sum("drawn").alias("total"))
    j = j.crossJoin(F.broadcast(total))  # one row
    zero = {"target_share": 0.0, "max_repeats": 0, "epochs": 0.0, "available": 0, "documents": 0, "drawn": 0, "most_copies": 0, "capped": False}
    return j.fillna(zero).select("source", "target_share", "max_repeats", "available", "documents", "epochs", "capped", "drawn", "most_copies",
                                 F.when(F.coalesce("total", F.lit(0)) > 0, F.col("drawn") / F.col("total")).otherwise(0.0).alias("actual_share"))


def document_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, tokens), written once as several passes read it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return Scratch(spark, "sizes").cut(token_counts(docs))[0]


def drawn_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p7_draw``: the documents of the mixture and how often each occurs."""
    sizes = document_sizes(spark, sf_dir)
    return draw(spark, sizes, allotment(sizes, table(spark, sf_dir, "mix_targets")))


def reached_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p7_shares``: targets and reached shares per source."""
    sizes = document_sizes(spark, sf_dir)
    shares = allotment(sizes, table(spark, sf_dir, "mix_targets"))
    return report(spark, sizes, draw(spark, sizes, shares), shares)


def character_allotment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p7_allotment``: what each source is asked for if sizes are characters: the water-filling alone, without a draw."""
    sizes = table(spark, sf_dir, "documents").select("source", F.col("n_chars").alias("tokens"))
    rows = [(s.source, s.target, s.cap, s.size, s.wanted, s.epochs) for s in allotment(sizes, table(spark, sf_dir, "mix_targets"))]
    out = spark.createDataFrame(rows, "source STRING, target_share DOUBLE, max_repeats INT, size BIGINT, wanted DOUBLE, epochs DOUBLE")
    return out.select("source", F.round("target_share", 6).alias("target_share"), "max_repeats", "size", F.round("wanted", 3).alias("wanted"), F.round("epochs", 6).alias("epochs"))
