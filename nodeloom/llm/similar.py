"""The k most similar vectors for every query vector, over robust-pruned graphs of shards.

All vectors are indexed: a hash of the id spreads them over shards of about ``SHARD`` vectors, every shard gets one graph
(``vamana``) over its different vectors, and every query is answered by beam search in every shard. Queries are rows like
any others: they are spread over tiles of ``TILE``, and a task searches the shards of a group for the queries of a tile and
keeps the k best of each, so neither side is ever held by the driver and what is shuffled to the final top k is k rows for
every query and group. One tile of queries is searched where the graphs are built; for more, the graphs are built once,
written, and read by all tiles. Both ways, and any number of cores, give the same pairs. Their cosines are exact.

Defined results: a vector without exactly ``dim`` finite numbers, or all zero, takes no part, nor does a null id; an id
counts once, with the smallest of its usable vectors; of equal cosines the smallest ids win; a query is never its own
neighbour; with fewer than k other vectors all of them are given; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from nodeloom.llm.vamana import PrunedGraph
from nodeloom.runtime import Scratch, table

#: Vectors of one graph, width of query beams, queries of one tile, and the most shards of a group.
SHARD, SEARCH, TILE, GROUP = 8192, 48, 65_536, 16
_PAIRS = "query STRING, neighbour STRING, cos DOUBLE"


def usable(v: Column, dim: int) -> Column:
    """Exactly ``dim`` finite numbers, not all zero; null gives false. Compiled functions only."""
    inf = F.lit(float("inf"))
    ok = (F.size(F.array_compact(v)) == dim) & (F.size(v) == dim) & (F.array_max(v) < inf) & (F.array_min(v) > -inf)
    return F.coalesce(ok & ((F.array_max(v) > 0) | (F.array_min(v) < 0)), F.lit(False))


def distinct_vectors(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(id, vec) of the usable vectors, one per id; copies collapse before the shuffle."""
    d = df.filter(F.col(key).isNotNull() & usable(F.col(vector), dim))
    return d.groupBy(F.col(key).cast("string").alias("id")).agg(F.min(F.col(vector).cast("array<float>")).alias("vec"))


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # no overflow of the squares
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _vectors(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    if not len(column):
        return np.zeros((0, dim))
    return _unit(np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]), dim)


def _texts(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), object)


class _Shard:
    """A graph over the different vectors of a shard, with the ids that share each."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        o = np.argsort(ids, kind="stable")
        ids, x = ids[o], x[o]
        f = np.ascontiguousarray(x.astype(np.float32))
        _, first, back = np.unique(f.view(f"V{f.itemsize * f.shape[1]}").ravel(), return_index=True, return_inverse=True)
        self.ids, self.x, self.f = ids, x[first], np.ascontiguousarray(f[first])
        self.members = np.argsort(back, kind="stable")
        self.count = np.bincount(back, minlength=len(first))
        self.begin = np.cumsum(self.count) - self.count

    def search(self, q: np.ndarray, k: int, beam: int, graph: PrunedGraph) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines), k best per query; empty ids pad."""
        at, _ = graph.search(np.ascontiguousarray(q.astype(np.float32)), max(beam, k))
        at = at[:, :k]
        cos = np.matmul(self.x[np.maximum(at, 0)], q[:, :, None])[:, :, 0]
        cos[at < 0] = -2.0
        if (self.count == 1).all():
            ids = np.where(at >= 0, self.ids[self.members[np.maximum(at, 0)]], "")
            return ids, cos
        out_i, out_c = np.full(at.shape, "", object), np.full(at.shape, -2.0)
        for r in range(len(q)):
            n = 0
            for u in np.argsort(-cos[r], kind="stable"):
                if at[r, u] < 0 or n == k:
                    break
                b = self.begin[at[r, u]]
                m = self.ids[self.members[b : b + min(self.count[at[r, u]], k - n)]]
                out_i[r, n : n + len(m)], out_c[r, n : n + len(m)] = m, cos[r, u]
                n += len(m)
        return out_i, out_c


def _best(ids: np.ndarray, cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, equal cosines by id."""
    o = np.argsort(-cos, 1, kind="stable")
    c = np.take_along_axis(cos, o, 1)
    if c.shape[1] > k:
        for r in np.flatnonzero((c[:, k - 1] == c[:, k]) & (c[:, k] > -2)):
            o[r] = np.lexsort((ids[r].astype(str), -cos[r]))
    o = o[:, :k]
    return np.take_along_axis(ids, o, 1), np.take_along_axis(cos, o, 1)


def _answer(query_ids: np.ndarray, q: np.ndarray, shards, k: int, beam: int) -> pa.Table:
    """The k best of each query over (shard, graph) pairs."""
    best = None
    for s, g in shards:
        got = s.search(q, k, beam, g)
        best = _best(*got, k) if best is None else _best(np.concatenate([best[0], got[0]], 1), np.concatenate([best[1], got[1]], 1), k)
    if best is None:
        best = np.full((len(q), 0), "", object), np.zeros((len(q), 0))
    ids, cos = best
    ok = cos > -2
    return pa.table({"query": pa.array(np.repeat(query_ids, ok.sum(1)), pa.string()), "neighbour": pa.array(ids[ok], pa.string()), "cos": pa.array(cos[ok], pa.float64())})


def _parted(t: pa.Table):
    """The rows of each shard of a group."""
    shard = t.column("shard").to_numpy()
    for x in np.unique(shard):
        yield t.filter(pa.array(shard == x))


def _sharded(vectors: DataFrame, shards: int, group: int) -> DataFrame:
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    return vectors.select("id", "vec", shard.alias("shard"), F.floor(shard / group).cast("int").alias("g"))


def build_index(spark: SparkSession, vectors: DataFrame, dim: int, shards: int, group: int) -> DataFrame:
    """The written index: (g, shard, at, vec, edges, ids), a row per different vector of a shard with the ids that share it."""

    def run(t: pa.Table) -> pa.Table:
        out = []
        for part in _parted(t):
            s = _Shard(_texts(part.column("id")), _vectors(part.column("vec"), dim))
            g = PrunedGraph(s.f)
            ids = np.split(s.ids[s.members], np.cumsum(s.count)[:-1])
            n, own = len(s.f), part.slice(0, 1)
            out.append(pa.table({
                "g": pa.array([own.column("g")[0].as_py()] * n, pa.int32()), "shard": pa.array([own.column("shard")[0].as_py()] * n, pa.int32()), "at": pa.array(np.arange(n, dtype=np.int32)),
                "vec": pa.FixedSizeListArray.from_arrays(pa.array(s.f.ravel()), dim).cast(pa.list_(pa.float32())),
                "edges": pa.FixedSizeListArray.from_arrays(pa.array(g.out.ravel()), g.slots).cast(pa.list_(pa.int32())),
                "ids": pa.array([x.tolist() for x in ids], pa.list_(pa.string())),
            }))
        return pa.concat_tables(out)

    out = _sharded(vectors, shards, group).groupBy("g").applyInArrow(run, "g INT, shard INT, at INT, vec ARRAY<FLOAT>, edges ARRAY<INT>, ids ARRAY<STRING>")
    return Scratch(spark, "vectors").cut(out)[0]


def _stored(t: pa.Table, dim: int):
    for part in _parted(t):
        part = part.sort_by("at").combine_chunks()
        s = _Shard.__new__(_Shard)
        s.f = np.ascontiguousarray(part.column("vec").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
        s.x = _unit(s.f.ravel(), dim)
        ids = part.column("ids").to_pylist()
        s.count = np.array([len(x) for x in ids])
        s.ids = np.array([y for x in ids for y in x], object)
        s.members, s.begin = np.arange(len(s.ids)), np.cumsum(s.count) - s.count
        yield s, PrunedGraph.read(s.f, part.column("edges").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(len(s.f), -1))


def most_similar(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 10, dim: int = 64,
                 shard: int = SHARD, beam: int = SEARCH, tile: int = TILE) -> DataFrame:
    """(query, neighbour, cos, rank) for (id, vec) frames with one row per id."""
    tiles = max(1, -(-queries.count() // tile))
    shards = max(1, -(-vectors.count() // shard))
    group = max(1, min(GROUP, shards // (2 * spark.sparkContext.defaultParallelism)))
    groups = F.sequence(F.lit(0), F.lit((shards - 1) // group))
    asked = queries.select(F.col("id").alias("asked"), F.col("vec").alias("q"), F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int").alias("tile"), F.explode(groups).alias("g"))

    def fused(v: pa.Table, q: pa.Table) -> pa.Table:
        own = ((s, PrunedGraph(s.f)) for s in (_Shard(_texts(t.column("id")), _vectors(t.column("vec"), dim)) for t in _parted(v))) if q.num_rows else ()
        return _answer(_texts(q.column("asked")), _vectors(q.column("q"), dim), own, k + 1, beam)

    def stored(v: pa.Table, q: pa.Table) -> pa.Table:
        return _answer(_texts(q.column("asked")), _vectors(q.column("q"), dim), _stored(v, dim) if q.num_rows else (), k + 1, beam)

    parts = min(20_000, ((shards - 1) // group + 1) * tiles)
    if tiles == 1:
        left, keys, run = _sharded(vectors, shards, group), ["g"], fused
    else:
        index = build_index(spark, vectors, dim, shards, group)
        left, keys, run = index.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))), ["g", "tile"], stored
    found = left.repartition(parts, *keys).groupBy(*keys).cogroup(asked.repartition(parts, *keys).groupBy(*keys)).applyInArrow(run, _PAIRS)
    w = W.partitionBy("query").orderBy(F.col("cos").desc(), "neighbour")
    return found.filter("query != neighbour").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def similar_senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p3_found``: pairs of a probed sense and one of its ten nearest other senses."""
    probes = table(spark, sf_dir, "knn_probes").select(F.col("sense_id").alias("id")).distinct()
    vectors, _ = Scratch(spark, "distinct").cut(distinct_vectors(table(spark, sf_dir, "parsed_senses"), "sense_id", "vector", 64))
    near = most_similar(spark, vectors, vectors.join(probes, "id", "left_semi"))
    pair = near.select(F.least("query", "neighbour").alias("sense_a"), F.greatest("query", "neighbour").alias("sense_b"))
    return pair.distinct()
