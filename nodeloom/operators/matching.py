"""One-to-one matching without a sequential scan.

Greedy matching takes pairs in descending order and skips taken ends. The same result comes from rounds: every end names
its best remaining pair, pairs named by both ends are taken, pairs of taken ends leave. Assigning each pair, in order,
its best free bridge is a serial dictatorship; the same result comes from deferred acceptance, as all bridges rank pairs
by that order, and pairs that run out of candidates may be given more later. Rounds aggregate per end with partial aggregation and end on anti-joins, so hot ends are no hot tasks.
What is left below ``IN_TASK`` rows is finished by the plain scan in one task, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from nodeloom.runtime import Scratch, count_where


#: Rows of pairs or candidates that one task may scan.
IN_TASK = 500_000


def _scan_pairs(batches):
    taken: set = set()
    for b in batches:
        keep = []
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist()):
            ok = x not in taken and y not in taken
            keep.append(ok)
            if ok:
                taken.add(x)
                taken.add(y)
        yield b.filter(pa.array(keep, pa.bool_()))


def _scan_candidates(batches):
    """First free bridge per pair; rows come in order of (rank, pref). A pair without any gets a row without bridge."""
    taken: set = set()
    at, won = None, True
    out: list[tuple] = []
    for b in batches:
        for p, x, s, f in zip(*(b.column(c).to_pylist() for c in ("pair", "bridge", "score", "pref"))):
            if p != at:
                if not won:
                    out.append((at, None, None, None))
                at, won = p, False
            if not won and x not in taken:
                won = True
                taken.add(x)
                out.append((p, x, s, f))
    if not won:
        out.append((at, None, None, None))
    kinds = (("pair", pa.string()), ("bridge", pa.string()), ("score", pa.float64()), ("pref", pa.int32()))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(list(zip(*out)) or [()] * 4, kinds)], names=[n for n, _ in kinds])


def greedy(spark: SparkSession, pairs: DataFrame, order: list[Column], scratch: Scratch | None = None, in_task: int | None = None) -> DataFrame:
    """The pairs (a, b, ...) that greedy one-to-one matching takes in ascending ``order`` (must be total over (a, b)).

    Null ends are no pairs; a pair of an end with itself is never taken; repeated pairs count once."""
    s = scratch or Scratch(spark, "greedy")
    cols = pairs.columns
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], F.col("a").alias("ka"), F.col("b").alias("kb")).alias("_k")
    left, c = s.cut(pairs.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))), n=F.count(F.lit(1)))
    most = IN_TASK if in_task is None else in_task
    taken = []
    while c["n"]:
        if c["n"] <= most:
            rest = left.select(*cols, key).repartition(1).sortWithinPartitions("_k").select(*cols)
            won, _ = s.cut(rest.mapInArrow(_scan_pairs, rest.schema))
            taken.append(won)
            break
        ends = left.select(F.col("a").alias("e"), key).unionByName(left.select(F.col("b").alias("e"), key))
        best = ends.groupBy("e").agg(F.min("_k").alias("_k"))
        both = best.groupBy("_k").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select("_k.*")
        both = both.select(F.col("ka").alias("a"), F.col("kb").alias("b"), *[F.col(f"k{i}") for i in range(len(order))])
        won = left.select(*cols, *[x.alias(f"k{i}") for i, x in enumerate(order)]).join(both, both.columns, "left_semi")
        won, _ = s.cut(won.select(*cols).dropDuplicates(["a", "b"]))
        taken.append(won)
        gone = won.select(F.col("a").alias("e")).unionByName(won.select(F.col("b").alias("e")))
        nxt = left.join(gone.withColumnRenamed("e", "a"), "a", "left_anti").join(gone.withColumnRenamed("e", "b"), "b", "left_anti")
        nxt, c = s.cut(nxt.select(*cols), n=F.count(F.lit(1)))
        s.drop(left)
        left = nxt
    return _all([t.select(*cols) for t in taken]) if taken else left.select(*cols)


def greedy_by_score(spark: SparkSession, pairs: DataFrame, threshold: float, floor: float | None = None) -> DataFrame:
    """Greedy matching of (a, b, score[, same]) by descending raw score; pairs flagged ``same`` are raised to ``floor``.

    Gives (a, b, score, q): q is the raised score and from ``threshold`` on; raising does not change the order."""
    q = F.col("score") if floor is None else F.when(F.col("same"), F.greatest("score", F.lit(floor))).otherwise(F.col("score"))
    p = pairs.select("a", "b", "score", q.alias("q")).filter(F.col("q") >= threshold)
    return greedy(spark, p, [-F.col("score")])


def by_tiers(spark: SparkSession, relations: DataFrame) -> DataFrame:
    """Tiered matching of (tier, a, b, ord_a, ord_rel, ...): tiers in order, within a tier by (ord_a, ord_rel).

    As one greedy pass whose order begins with the tier: a pair of a later tier can win an end only once no pair of an
    earlier tier has it."""
    return greedy(spark, relations, [F.col("tier"), F.col("ord_a"), F.col("ord_rel")])


def _first_by_rank(s: Scratch, pairs: DataFrame, n: int) -> DataFrame:
    """The ``n`` pairs of lowest rank: whole ranges of the rank, and the beginning of the one in which the count is met."""
    p, _ = s.cut(pairs.repartitionByRange(max(8, pairs.sparkSession.sparkContext.defaultParallelism), "rank").withColumn("_p", F.spark_partition_id()))
    sizes = sorted((r["_p"], r["n"]) for r in p.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect())  # a row per range
    whole, before = -1, 0
    for at, k in sizes:
        if before + k > n:
            break
        whole, before = at, before + k
    nxt = min((at for at, _ in sizes if at > whole), default=None)
    edge = p.filter(F.col("_p") == nxt) if nxt is not None else p.limit(0)
    edge = edge.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy("rank"))).filter(F.col("_r") <= n - before).drop("_r")
    return p.filter(F.col("_p") <= whole).unionByName(edge).drop("_p")


def assign_bridges(spark: SparkSession, pairs: DataFrame, candidates: Callable[[DataFrame, int], DataFrame], n_bridges: int, first: int = 50, in_task: int | None = None) -> DataFrame:
    """(pair, bridge, score): each pair of (pair, rank, ...), in order of rank, gets its best bridge not taken before.

    candidates(pairs, k) gives (pair, bridge, score, pref) with the k best bridges of each pair, pref from 1. As every
    pair takes one bridge while any is free, only the first ``n_bridges`` pairs can get one. A pair that runs out of
    candidates is given four times as many and goes on from there; all others keep what they hold, as deferred acceptance
    allows offers in any order."""
    s = Scratch(spark, "bridges")
    most = IN_TASK if in_task is None else in_task
    if pairs.count() > n_bridges:
        pairs, _ = s.cut(_first_by_rank(s, pairs, n_bridges))
    k = min(first, n_bridges)
    order = pairs.select("pair", "rank")
    one, c = s.cut(candidates(pairs, k).select("pair", "bridge", "score", F.col("pref").cast("int").alias("pref")), n=F.count(F.lit(1)))
    cand = [one]
    if c["n"] <= most:
        rows = one.join(order, "pair").repartition(1).sortWithinPartitions("rank", "pref").select("pair", "bridge", "score", "pref")
        got, d = s.cut(rows.mapInArrow(_scan_candidates, "pair string, bridge string, score double, pref int").join(order, "pair"), none=count_where(F.col("bridge").isNull()))
        held = got.filter("bridge IS NOT NULL")
        free, open_, out = got.filter("bridge IS NULL").select("pair", "rank", F.lit(k + 1).alias("at"), F.lit(k).alias("have")), 0, d["none"]
        held = held.select("bridge", "pair", "rank", "score", "pref", F.lit(k).alias("have"))
    else:
        held = None
        free, open_, out = order.select("pair", "rank", F.lit(1).alias("at"), F.lit(k).alias("have")), 1, 0
    waiting = []
    while open_ or out or waiting:
        if not open_:
            rest = _all([*waiting, free])
            waiting = []
            rest = rest.filter(F.col("have") < n_bridges)
            if rest.isEmpty():
                break
            k = min(n_bridges, k * 4)
            rest, _ = s.cut(rest.select("pair", "rank", "at", F.col("have").alias("had"), F.lit(k).alias("have")))
            more = candidates(pairs.join(rest.select("pair"), "pair", "left_semi"), k).join(rest.select("pair", "had"), "pair").filter(F.col("pref") > F.col("had"))
            cand.append(s.cut(more.select("pair", "bridge", "score", F.col("pref").cast("int").alias("pref")))[0])
            free, open_, out = rest, 1, 0
            continue
        live = free.filter("at <= have")
        if out:
            waiting.append(free.filter("at > have"))
        f = live.select(F.col("pair").alias("_pair"), "rank", "at", "have")
        offers = [f.join(x, (F.col("_pair") == F.col("pair")) & (F.col("at") == F.col("pref"))).select("bridge", "pair", "rank", "score", "pref", "have") for x in cand]
        allp = _all(offers if held is None else [*offers, held])
        top = allp.groupBy("bridge").agg(F.min(F.struct("rank", "pair", "score", "pref", "have")).alias("m"))
        now, _ = s.cut(top.select("bridge", "m.pair", "m.rank", "m.score", "m.pref", "m.have"))
        lost = allp.join(now.select("pair"), "pair", "left_anti").select("pair", "rank", (F.col("pref") + 1).alias("at"), "have")
        free, d = s.cut(lost, open=count_where(F.col("at") <= F.col("have")), out=count_where(F.col("at") > F.col("have")))
        held, open_, out = now, d["open"], d["out"]
    return held.select("pair", "bridge", "score")


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def ranked(pairs: DataFrame, *order: Column) -> DataFrame:
    """``pairs`` with ``rank`` in a total order that compares like a number but needs no global sort: a struct of the keys."""
    return pairs.withColumn("rank", F.struct(*[c.alias(f"r{i}") for i, c in enumerate(order)]))


def best_per_group(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group in the given order (top-1 with a partial group limit before the shuffle)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
