"""Statistics, upserts, set operations and evaluation over dictionary and graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from nodeloom.functions.text import normalize_term


def last_wins(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key: the last in ``order``. A partial maximum per task precedes the shuffle, so hot keys stay small."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    d = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_s"))
    return d.select(*keys, *[F.col(f"_s.{c}").alias(c) for c in df.columns if c not in keys]).select(*df.columns)


def upsert(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with the rows of ``updates`` (one per key) replacing those of equal key and added otherwise."""
    return target.join(updates.select(*keys), keys, "left_anti").unionByName(updates, allowMissingColumns=True)


def set_parent(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Set ``parent_edge_id`` of the members of (member_id, parent); of several parents the largest."""
    m = members.groupBy(F.col("member_id").alias("id")).agg(F.max("parent").alias("_p"))
    return docs.join(m, "id", "left").withColumn("parent_edge_id", F.coalesce("_p", "parent_edge_id")).drop("_p")


def set_add(old: Column, new: Column) -> Column:
    return F.array_distinct(F.concat(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>"))))


def merge_updates(target: DataFrame, updates: DataFrame, keys: list[str], add: dict[str, str] | None = None, inc: dict[str, str] | None = None,
                  put: dict[str, str] | None = None, first: dict[str, str] | None = None) -> DataFrame:
    """``target`` with ``updates`` (any number of rows per key) merged by key; keys it has not are added.

    Each maps a column of the target to one of the updates: ``add`` unites string sets, ``inc`` adds numbers (none counts
    0), ``put`` overwrites with the largest value given, ``first`` sets a column of new keys only."""
    add, inc, put, first = add or {}, inc or {}, put or {}, first or {}
    aggs = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(f"_{t}") for t, c in add.items()]
    aggs += [F.sum(c).alias(f"_{t}") for t, c in inc.items()] + [F.max(c).alias(f"_{t}") for t, c in {**put, **first}.items()]
    u = updates.dropna(subset=keys).groupBy(*keys).agg(F.lit(True).alias("_new"), *aggs)
    j = target.withColumn("_old", F.lit(True)).join(u, keys, "full")

    def of(c: str) -> Column:
        if c in add:
            return set_add(F.col(c), F.col(f"_{c}"))
        if c in inc:
            return F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0))
        if c in put:
            return F.coalesce(f"_{c}", c)
        return F.when(F.col("_old").isNull(), F.col(f"_{c}")).otherwise(F.col(c)) if c in first else F.col(c)

    return j.select(*[F.col(c) if c in keys else of(c).alias(c) for c in target.columns])


def write_labels(docs: DataFrame, labels: DataFrame, dim: int, guarded: bool = True) -> DataFrame:
    """Labels of (id, semantic_label, label_vector, label_model) on edges of level 13 and below.

    guarded: a label that is there stays. Vectors of another length are refused; of several labels the smallest counts."""
    ok = labels.filter((F.size("label_vector") == dim) & F.col("semantic_label").isNotNull())
    ok = ok.groupBy("id").agg(F.min(F.struct("semantic_label", "label_vector", "label_model")).alias("_s")).select("id", "_s.*")
    new = ok.select("id", F.col("semantic_label").alias("_l"), F.col("label_vector").alias("_v"), F.col("label_model").alias("_m"))
    can = (F.col("doc_type") != "node") & (F.col("level") <= 13) & F.col("_l").isNotNull()
    if guarded:
        can = can & F.col("semantic_label").isNull()
    d = docs.join(new, "id", "left").withColumn("_can", F.coalesce(can, F.lit(False)))
    for c, n in (("semantic_label", "_l"), ("label_vector", "_v"), ("label_model", "_m")):
        d = d.withColumn(c, F.when(F.col("_can"), F.col(n)).otherwise(F.col(c)))
    return d.withColumn("label_updated_at", F.when(F.col("_can"), F.current_timestamp()).otherwise(F.col("label_updated_at"))).drop("_l", "_v", "_m", "_can")


def dedupe_union(entries: DataFrame, term: str, gloss: str, source: str, order: str) -> DataFrame:
    """One row per (normalised term, gloss): the first in ``order``, with the sorted different sources of all copies."""
    e = entries.withColumn("_t", normalize_term(F.col(term)))
    rest = [c for c in entries.columns if c not in (order, source)]
    g = e.groupBy("_t", gloss).agg(F.min(F.struct(order, *[c for c in rest if c != gloss])).alias("_s"), F.array_sort(F.collect_set(source)).alias("sources"))
    return g.select(F.col("_t").alias("norm_term"), F.col(gloss), *[F.col(f"_s.{c}").alias(c) for c in (order, *[c for c in rest if c != gloss])], "sources")


def unordered_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Different unordered pairs of (a, b); pairs with a null or of equal ends are none."""
    p = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    return p.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def orphan_stats(docs: DataFrame) -> DataFrame:
    """Documents without parent per (doc_type, level): total, orphans and per cent with one decimal."""
    orphan = F.col("parent_edge_id").isNull() | (F.col("parent_edge_id") == "")
    g = docs.groupBy("doc_type", "level").agg(F.count(F.lit(1)).alias("total"), F.sum(F.when(orphan, 1).otherwise(0)).alias("orphans"))
    return g.withColumn("pct", F.round(F.lit(100.0) * F.col("orphans") / F.col("total"), 1))


def breakdown(docs: DataFrame) -> DataFrame:
    """Counts per (doc_type, level, node_type, edge_type)."""
    return docs.groupBy("doc_type", "level", "node_type", "edge_type").agg(F.count(F.lit(1)).alias("n"))


def threshold_histogram(scores: DataFrame, base: float, floor: float) -> DataFrame:
    """Scores per hundredth from ``floor`` on; the top bucket holds all from ``base`` on."""
    s = scores.filter(F.col("score") >= floor)
    b = F.when(F.col("score") >= base, F.lit(base)).otherwise(F.floor(F.round(F.col("score") * 100, 9)) / 100)
    return s.groupBy(F.round(b, 2).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def value_ranks(d: DataFrame, c: str, ranges: int = 64) -> DataFrame:
    """(c, r): the average rank of each different value, from counts per value and running sums within value ranges."""
    g = d.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    cuts = sorted(set(g.select(F.col(c).cast("double")).approxQuantile(c, [i / ranges for i in range(1, ranges)], 0.01)))
    part = sum((F.when(F.col(c) >= x, 1).otherwise(0) for x in cuts), F.lit(0))
    g = g.withColumn("_p", part)
    sums = g.groupBy("_p").agg(F.sum("n").alias("_n"))
    sums = sums.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    run = F.coalesce(F.sum("n").over(W.partitionBy("_p").orderBy(c).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    g = g.withColumn("_b", run).join(F.broadcast(sums), "_p")  # as many rows as ranges
    return g.select(c, (F.col("_base") + F.col("_b") + (F.col("n") + 1) / 2.0).alias("r"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks for ties; one row (rho, n)."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    j = d.join(value_ranks(d, "x").withColumnRenamed("r", "rx"), "x").join(value_ranks(d, "y").withColumnRenamed("r", "ry"), "y")
    return j.agg(F.corr("rx", "ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def recall_at_k(hits: DataFrame) -> DataFrame:
    """(method, recall, n) of (method, pair, hit BOOLEAN)."""
    return hits.groupBy("method").agg(F.avg(F.col("hit").cast("int")).alias("recall"), F.count(F.lit(1)).alias("n"))


def overlap(sets: DataFrame, a: str, b: str) -> DataFrame:
    """``overlap`` and ``jaccard`` of two array columns as sets."""
    i, u = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return sets.withColumn("overlap", i).withColumn("jaccard", F.when(u > 0, i / u).otherwise(F.lit(0.0)))


def seeded_order(seed: int, *keys: str) -> list[Column]:
    """A random order fixed by the seed and the keys alone, the same in any engine that has MD5."""
    return [F.md5(F.concat_ws("|", F.lit(str(seed)), *keys)), *map(F.col, keys)]


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows, uniformly by a seeded hash of the key: the same rows at every run and partitioning."""
    return df.orderBy(*seeded_order(seed, key)).limit(n)


def page(df: DataFrame, key: str, limit: int, offset: int) -> DataFrame:
    return df.orderBy(key).offset(offset).limit(limit)


def pair_metrics(pairs: DataFrame, edges: DataFrame, chains: DataFrame) -> DataFrame:
    """Relatedness of word pairs (a, b) in the graph: edge_overlap, word_overlap, word_jaccard, direct_hit, bridge_level_min.

    edges: (word, edge_id, partner), each edge at a word with the word at its other end; chains: (word, id, level), the
    triads above a word. All are set sizes over joins, so no set is collected; a pair without anything in common gets 0s."""
    p = pairs.select("a", "b").distinct()

    def shared(rows: DataFrame, item: str, agg: Column) -> DataFrame:
        r = rows.filter(F.col("word").isNotNull() & F.col(item).isNotNull()).select("word", item, *[c for c in rows.columns if c == "level"]).distinct()
        left = p.join(r.withColumnRenamed("word", "a"), "a")
        return left.join(r.select(F.col("word").alias("b"), item), ["b", item]).groupBy("a", "b").agg(agg)

    n = edges.filter(F.col("partner").isNotNull()).select("word", "partner").distinct()
    size = n.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    hit = n.select(F.col("word").alias("a"), F.col("partner").alias("b"), F.lit(1).alias("direct_hit"))
    j = p.join(shared(edges, "edge_id", F.count(F.lit(1)).alias("edge_overlap")), ["a", "b"], "left")
    j = j.join(shared(n, "partner", F.count(F.lit(1)).alias("word_overlap")), ["a", "b"], "left")
    j = j.join(shared(chains, "id", F.min("level").alias("bridge_level_min")), ["a", "b"], "left")
    j = j.join(hit.unionByName(hit.select(F.col("b").alias("a"), F.col("a").alias("b"), "direct_hit")).distinct(), ["a", "b"], "left")
    j = j.join(size.select(F.col("word").alias("a"), F.col("n").alias("na")), "a", "left").join(size.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b", "left")
    j = j.fillna(0, ["edge_overlap", "word_overlap", "direct_hit", "na", "nb"])
    union = F.col("na") + F.col("nb") - F.col("word_overlap")
    jaccard = F.when(union > 0, F.col("word_overlap") / union).otherwise(F.lit(0.0))
    return j.select("a", "b", "edge_overlap", "word_overlap", jaccard.alias("word_jaccard"), "direct_hit", "bridge_level_min")
