"""Similarity joins over vectors: top k, nearest row, pairs above a cosine.

Both sides of a join are spread over tiles of bounded bytes by a hash of their ids, every tile of one side meets every
tile of the other in a group of its own, and each group gives its best rows or its pairs before the next shuffle: no
vector is held by the driver or broadcast, and no task holds more than two tiles. ``pairs`` is exact unless a recall is
asked for; ``pairs_approximate`` then cuts the vectors into cells by random hyperplanes in as many tables as that recall
takes at the least cosine, and compares only pairs within a cell, exactly.

Vectors that are null, zero, not finite or of another length than ``dim`` take no part. Equal cosines go by id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from nodeloom.functions import vectors as V
from nodeloom.runtime import Scratch

#: Bytes of the vectors of one tile (as doubles), rows from which a table is spread over all cores, rows compared within one
#: cell, and the most partitions of a join.
TILE_BYTES, SPREAD_ROWS, CELL, MOST_PARTS = 64 << 20, 256, 2000, 20_000
#: Rows by columns of the cosines a pair join holds at once.
TILE = 512, 2048


def unit_rows(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.reshape(-1, dim).astype(np.float64)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def usable(df: DataFrame, vec: str, dim: int) -> DataFrame:
    v, inf = F.col(vec), F.lit(float("inf"))
    ok = (F.size(v) == dim) & (F.size(F.array_compact(v)) == dim) & (F.array_max(v) < inf) & (F.array_min(v) > -inf)
    return df.filter(ok & ((F.array_max(v) != 0) | (F.array_min(v) != 0)))


def top_k(df: DataFrame, query: list[float], k: int, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """The k rows of highest cosine with one query vector, as (id, score); filter ``df`` before. One pass, bounded state."""
    q = F.array(*[F.lit(float(x)) for x in query])
    s = df.select(F.col(id_col), V.cosine(F.col(vec), q).alias("score")).filter(F.col("score").isNotNull() & ~F.isnan("score"))
    return s.orderBy(F.col("score").desc(), id_col).limit(k)


def top_k_by_row(df: DataFrame, query: DataFrame, k: int, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """``top_k`` with the query vector of a one-row frame (column q), joined in the plan."""
    s = df.crossJoin(F.broadcast(query.limit(1))).select(F.col(id_col), V.cosine(F.col(vec), F.col("q")).alias("score"))
    s = s.filter(F.col("score").isNotNull() & ~F.isnan("score"))
    return s.orderBy(F.col("score").desc(), id_col).limit(k)


def _id_type(df: DataFrame) -> str:
    return dict(df.dtypes)["id"]


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]


def _tile_count(n: int, dim: int, rows: int | None, spread: int) -> int:
    """Tiles of a side of ``n`` rows: none larger than ``rows`` (by default what ``TILE_BYTES`` hold), and up to ``spread`` so
    long as they keep ``SPREAD_ROWS`` rows."""
    most = rows or max(1, TILE_BYTES // (8 * dim))
    return max(1, -(-n // most), min(spread, n // SPREAD_ROWS))


def _numbers(n: int) -> F.Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def _vectors(t: pa.Table, dim: int, name: str = "vec") -> np.ndarray:
    if not t.num_rows:
        return np.zeros((0, dim))
    return unit_rows(np.concatenate([k.flatten().to_numpy(zero_copy_only=False) for k in t.column(name).chunks]), dim)


def _best(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k largest of each row, of equal ones the first columns; in order."""
    if k == 1:
        return np.arange(len(v)), np.argmax(v, 1)
    if v.shape[1] > k:
        i, j = np.nonzero(v >= np.partition(v, v.shape[1] - k, 1)[:, -k][:, None])
    else:
        i, j = (x.ravel() for x in np.indices(v.shape))
    o = np.lexsort((j, -v[i, j], i))
    i, j = i[o], j[o]
    at = np.arange(len(i)) - np.searchsorted(i, i)
    return i[at < k], j[at < k]


def nearest(left: DataFrame, right: DataFrame, dim: int, k: int = 1, min_score: float = -2.0, rows: int | None = None) -> DataFrame:
    """(id, match, score, rank): the k best rows of ``right`` (id, vec) for every row of ``left`` (id, vec), exactly.

    Each pair of tiles gives the k best of its part of ``right`` for every row of its part of ``left``."""
    left, right = usable(left, "vec", dim).select("id", "vec"), usable(right, "vec", dim).select("id", "vec")
    lt, rt = _id_type(left), _id_type(right)
    cores = left.sparkSession.sparkContext.defaultParallelism
    nl, nr = left.count(), right.count()
    a, b = _tile_count(nl, dim, rows, 4 * cores), _tile_count(nr, dim, rows, 1)
    parts = min(a * b, MOST_PARTS)

    def run(l: pa.Table, r: pa.Table) -> pa.Table:
        if not l.num_rows or not r.num_rows:
            return out_type.empty_table()
        r = r.sort_by("match")
        x, y = _vectors(l, dim), _vectors(r, dim, "mvec")
        li, rj, sc = [], [], []
        for p in range(0, len(x), TILE[0]):
            bi = np.zeros(0, np.int64)
            bj, bv = bi, np.zeros(0)
            for q in range(0, len(y), TILE[1]):
                v = np.round(x[p : p + TILE[0]] @ y[q : q + TILE[1]].T, 12)
                i, j = _best(v, k)
                s = v[i, j]
                ok = s >= min_score
                bi, bj, bv = np.concatenate([bi, i[ok]]), np.concatenate([bj, j[ok] + q]), np.concatenate([bv, s[ok]])
                if q:
                    o = np.lexsort((bj, -bv, bi))
                    bi, bj, bv = bi[o], bj[o], bv[o]
                    keep = np.arange(len(bi)) - np.searchsorted(bi, bi) < k
                    bi, bj, bv = bi[keep], bj[keep], bv[keep]
            li.append(bi + p), rj.append(bj), sc.append(bv)
        i, j = np.concatenate(li), np.concatenate(rj)
        return pa.table([l.column("id").take(pa.array(i)), r.column("match").take(pa.array(j)), pa.array(np.concatenate(sc))], schema=out_type)

    out_type = pa.schema([("id", _arrow(lt)), ("match", _arrow(rt)), ("score", pa.float64())])
    l = left.withColumn("_l", F.pmod(F.xxhash64("id"), F.lit(a)).cast("int")).withColumn("_r", F.explode(_numbers(b))).repartition(parts, "_l", "_r")
    r = right.select(F.col("id").alias("match"), F.col("vec").alias("mvec"), F.pmod(F.xxhash64("id"), F.lit(b)).cast("int").alias("_r"), F.explode(_numbers(a)).alias("_l")).repartition(parts, "_l", "_r")
    found = l.groupBy("_l", "_r").cogroup(r.groupBy("_l", "_r")).applyInArrow(run, f"id {lt}, match {rt}, score double")
    w = W.partitionBy("id").orderBy(F.col("score").desc(), "match")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def neighbour_pairs(df: DataFrame, dim: int, k: int = 20, min_score: float = 0.0) -> DataFrame:
    """(a, b, score) with a < b: each row with its k nearest other rows from ``min_score`` on, every pair once."""
    d = df.select("id", "vec")
    n = nearest(d, d, dim, k + 1, min_score).filter("id <> match")
    n = n.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.col("score").desc(), "match"))).filter(F.col("rank") <= k)
    return n.select(F.least("id", "match").alias("a"), F.greatest("id", "match").alias("b"), "score").groupBy("a", "b").agg(F.max("score").alias("score"))


def top_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """The k pairs of highest score, equal ones by (a, b)."""
    return pairs.orderBy(F.col("score").desc(), "a", "b").limit(k)


def _above(x: np.ndarray, y: np.ndarray, min_score: float):
    """(i, j, score) of the rows of ``x`` and ``y`` with cosine from ``min_score`` on, tile by tile.

    Single precision only says which products to take in double: its error on unit rows is below ``(dim + 8) * 1.2e-7``."""
    fx, fy = x.astype(np.float32), y.astype(np.float32)
    least = np.float32(min_score - (x.shape[1] + 8) * 1.2e-7)
    for p in range(0, len(x), TILE[0]):
        for q in range(0, len(y), TILE[1]):
            near = fx[p : p + TILE[0]] @ fy[q : q + TILE[1]].T >= least
            i, j = np.divmod(np.flatnonzero(near), near.shape[1])
            few = len(i) * 16 < near.size
            s = np.einsum("ij,ij->i", x[i + p], y[j + q]) if few else (x[p : p + TILE[0]] @ y[q : q + TILE[1]].T)[i, j]
            v = np.round(s, 12)
            ok = v >= min_score
            yield i[ok] + p, j[ok] + q, v[ok]


def pairs_exact(df: DataFrame, dim: int, min_score: float, rows: int | None = None) -> DataFrame:
    """(a, b, score) with a < b of all pairs of (id, vec) with cosine from ``min_score`` on."""
    df = usable(df, "vec", dim).select("id", "vec")
    n = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    tiles = max(_tile_count(n, dim, rows, 1), min(math.isqrt(8 * cores), n // SPREAD_ROWS))
    return _compared(df.withColumn("tiles", F.lit(tiles)), [], dim, min_score, tiles * (tiles + 1) // 2)


def _cells(df: DataFrame, dim: int, tables: int, bits: int, seed: int) -> DataFrame:
    """(id, vec, cell): the cell of each vector in each table."""
    planes = np.random.default_rng(seed).standard_normal((tables, bits, dim))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = unit_rows(b.column(1).flatten().to_numpy(zero_copy_only=False), dim)
            for t in range(tables):
                cell = (x @ planes[t].T > 0) @ (1 << np.arange(bits, dtype=np.int64)) + (t << bits)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell)], names=["id", "vec", "cell"])

    return df.select("id", F.col("vec").cast("array<double>")).mapInArrow(run, f"id {_id_type(df)}, vec array<double>, cell bigint")


def write_index(spark: SparkSession, df: DataFrame, dim: int, path: str, min_score: float = 0.5, recall: float = 0.95, seed: int = 3) -> None:
    """A stored index of (id, vec): the rows of every cell together, sorted, so a search reads the row groups of its cells.

    A vector at cosine ``min_score`` to a query is found with probability ``recall`` at least, nearer ones more surely."""
    d = usable(df, "vec", dim)
    bits, tables = plan_cells(d.count(), min_score, recall)
    _cells(d.select("id", "vec"), dim, tables, bits, seed).repartitionByRange("cell").sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{path}/cells")
    spark.createDataFrame([(dim, bits, tables, seed)], "dim INT, bits INT, tables INT, seed INT").write.mode("overwrite").parquet(f"{path}/plan")


def search_index(spark: SparkSession, path: str, query: list[float], k: int) -> DataFrame:
    """(id, score): the k best rows of a stored index among those that share a cell with the query, by exact cosine."""
    m = spark.read.parquet(f"{path}/plan").first()  # one row
    planes = np.random.default_rng(m["seed"]).standard_normal((m["tables"], m["bits"], m["dim"]))
    on = np.einsum("tbd,d->tb", planes, np.asarray(query, float)) > 0
    cells = (on @ (1 << np.arange(m["bits"], dtype=np.int64))) + (np.arange(m["tables"], dtype=np.int64) << m["bits"])
    near = spark.read.parquet(f"{path}/cells").filter(F.col("cell").isin(cells.tolist())).dropDuplicates(["id"])
    return top_k(near, query, k)


def plan_cells(n: int, min_score: float, recall: float) -> tuple[int, int]:
    """(bits, tables) of least work with which a pair at ``min_score`` shares some cell with probability ``recall``.

    A plane parts a pair with the probability of its angle over pi, so both share a cell of ``bits`` planes with
    ``p ** bits``; tables are added until the chance to miss all of them is below ``1 - recall``. Pairs of higher cosine
    are found more surely."""
    p = 1 - math.acos(max(-1.0, min(1.0, min_score))) / math.pi
    best = None
    for bits in range(1, 33):
        share = p**bits
        if share >= 1:
            return 1, 1
        tables = max(1, math.ceil(math.log(1 - recall) / math.log1p(-share)))
        work = tables * (40.0 * n + n * n / 2.0**bits)  # a row's cells and their shuffle, against products
        if best is None or work < best[0]:
            best = work, bits, tables
    return best[1], best[2]


def pairs_approximate(spark: SparkSession, df: DataFrame, dim: int, min_score: float, recall: float = 0.95, tables: int | None = None, bits: int | None = None, cell: int = CELL, seed: int = 3) -> DataFrame:
    """(a, b, score) as ``pairs_exact``, of all pairs each with probability ``recall`` at least, at every size (see ``plan_cells``).

    A cell is compared in tiles of ``cell`` rows, so no pair of a cell is left out and no task holds more than two tiles."""
    df = usable(df, "vec", dim)
    if bits is None or tables is None:
        bits, tables = plan_cells(df.count(), min_score, recall)
    c, _ = Scratch(spark, "cells").cut(_cells(df, dim, tables, bits, seed))
    return _tiled(c.select("cell", "id", "vec"), ["cell"], dim, min_score, cell).select("a", "b", "score").dropDuplicates(["a", "b"])


def _tiled(c: DataFrame, keys: list[str], dim: int, min_score: float, cell: int) -> DataFrame:
    """(keys, a, b, score) of the pairs within each group of (keys, id, vec), compared in tiles of about ``cell`` rows."""
    n = c.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("tiles"))
    return _compared(c.join(n, keys), keys, dim, min_score)


def _compared(c: DataFrame, keys: list[str], dim: int, min_score: float, parts: int | None = None) -> DataFrame:
    """(keys, a, b, score) of the pairs within each group of (keys, id, vec, tiles), which is split into ``tiles`` tiles.

    Every tile meets every tile of its group once, as a group of its own of at most two tiles."""
    kind = _id_type(c)
    c = c.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles").cast("bigint")).cast("int"))
    c = c.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    c = c.select(*keys, F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "id", "vec")
    ends = [T.StructField(x, c.schema["id"].dataType) for x in ("a", "b")]
    out = T.StructType([T.StructField(k, c.schema[k].dataType) for k in keys] + ends + [T.StructField("score", T.DoubleType())])

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids = np.array(t.column("id").to_pylist(), object)
        x = _vectors(t, dim)
        side = t.column("tile").to_numpy()
        lo, hi = key[-2].as_py(), key[-1].as_py()
        p, q = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
        found = [(ids[p[i]], ids[q[j]], v) for i, j, v in _above(x[p], x[q], min_score)] if len(p) and len(q) else []
        a, b, v = (np.concatenate(y) for y in zip(*found)) if found else (np.zeros(0, object), np.zeros(0, object), np.zeros(0))
        keep = (a < b if lo == hi else a != b).astype(bool)
        a, b, v = a[keep], b[keep], v[keep]
        swap = (a > b).astype(bool)
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        own = [pa.array([k.as_py()] * len(a), t.schema.field(name).type) for k, name in zip(key, keys)]
        return pa.table([*own, pa.array(a.tolist(), _arrow(kind)), pa.array(b.tolist(), _arrow(kind)), pa.array(v, pa.float64())], names=[*keys, "a", "b", "score"])

    if parts is not None:
        c = c.repartition(min(parts, MOST_PARTS), *keys, "lo", "hi")
    return c.groupBy(*keys, "lo", "hi").applyInArrow(run, out)


def pairs(spark: SparkSession, df: DataFrame, dim: int, min_score: float, recall: float | None = None, rows: int | None = None) -> DataFrame:
    """All pairs above a cosine, exactly at every size; with ``recall`` each of them with that probability at least."""
    return pairs_exact(df, dim, min_score, rows) if recall is None else pairs_approximate(spark, df, dim, min_score, recall)


def pairs_within(df: DataFrame, keys: list[str], dim: int, min_score: float, small: int = 200, cell: int = CELL) -> DataFrame:
    """(keys, a, b, score) with a < b of the rows of (keys, id, vec) that share all ``keys``; null keys share nothing.

    Groups of up to ``small`` rows, such as the senses of a word, are an equi-join; larger ones are compared in tiles."""
    d = usable(df, "vec", dim).dropna(subset=keys).select(*keys, "id", "vec")
    big = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > small).select(*keys)
    few = d.join(big, keys, "left_anti")
    l = few.select(*keys, F.col("id").alias("a"), F.col("vec").alias("_va"))
    r = few.select(*keys, F.col("id").alias("b"), F.col("vec").alias("_vb"))
    j = l.join(r, keys).filter(F.col("a") < F.col("b")).select(*keys, "a", "b", V.cosine(F.col("_va"), F.col("_vb")).alias("score"))
    return j.filter(F.col("score") >= min_score).unionByName(_tiled(d.join(big, keys, "left_semi"), keys, dim, min_score, cell))
