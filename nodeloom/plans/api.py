"""Query interface over a built graph: searches, lookups, walks, and documents made by hand. All results are frames.

graph: the documents (see ``operators.graph``); vectors: (id, vec) of searchable documents; provenance: (doi, node_id).
Creating methods return the graph and vectors with the new document; nothing is changed in place.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from nodeloom.functions import text as X
from nodeloom.functions import vectors as V
from nodeloom.functions.embed import embed
from nodeloom.operators import graph as G
from nodeloom.operators import provenance as P
from nodeloom.operators import relational as R
from nodeloom.operators import simjoin as S
from nodeloom.options import TYPE_SENTENCES, Options
from nodeloom.plans.build import made_id
from nodeloom.plans.labels import unlabelled

# The seed weight each edge type takes when made by hand.
TYPE_SEEDS = {"contradicts": "contradicts", "applies_to": "applies_to", "is_instance_of": "is_instance_of", "extends": "extends", "same_phenomenon": "synonyms"}


#: Columns a tool reads or writes beside those every graph has, with their types; a graph without them has nulls there.
FIELDS = {
    "sense_idx": "int", "gloss": "string", "examples": "array<string>", "tags": "array<string>", "topics": "array<string>", "wikidata": "array<string>", "ipa": "string", "etymology": "string", "forms": "array<string>",
    "sense_ids": "array<string>", "surface": "int", "rotation": "double", "source": "string", "confidence": "double", "type_vector": "array<double>", "author": "string", "bridge_id": "string", "edge_type": "string", "q": "double",
    "connection_strength": "double", "accumulated_weight": "double", "semantic_label": "string",
}


def clamp(x: int, low: int, high: int) -> int:
    return max(low, min(high, int(x)))


def _triad_level(level: int) -> int:
    """A level whose triads are offered for sampling and labelling; raises for others."""
    if not 10 <= int(level) <= 13:
        raise ValueError("triads are sampled and labelled at levels 10 to 13")
    return int(level)


@dataclass(frozen=True)
class GraphAPI:
    spark: SparkSession
    graph: DataFrame
    vectors: DataFrame
    provenance: DataFrame | None = None
    options: Options = None  # type: ignore[assignment]

    def _ids(self, *ids: str) -> DataFrame:
        return self.spark.createDataFrame([(x,) for x in ids], "id STRING")

    def _of(self, *names: str) -> DataFrame:
        """The graph with the named columns, null where it has none."""
        return self.graph.withColumns({n: F.lit(None).cast(FIELDS[n]) for n in names if n not in self.graph.columns})

    def _one(self, doc_id: str) -> DataFrame:
        return self.graph.filter(F.col("id") == doc_id)

    def _with_dois(self, df: DataFrame, wanted: bool) -> DataFrame:
        if not wanted or self.provenance is None:
            return df
        return df.join(P.dois_of(self.provenance, df.select("id")), "id", "left")

    # searches

    def _hits(self, query: str | list[float], doc_type: str, top_k: int) -> DataFrame:
        d = self.vectors.join(self.graph.select("id", "doc_type"), "id")
        d = {"node": d.filter("doc_type = 'node'"), "any": d}.get(doc_type, d.filter("doc_type <> 'node'"))
        if isinstance(query, str):
            q = self.spark.createDataFrame([(query,)], "t STRING").select(embed(F.col("t"), self.options).alias("q"))
            return S.top_k_by_row(d, q, top_k)
        return S.top_k(d, query, top_k)

    def semantic_search(self, query, doc_type: str = "edge", top_k: int = 10, include_dois: bool = False) -> DataFrame:
        """(id, score, doc_type, level, label, words[, dois]): best hits with the words of their leaves."""
        h, _ = self._cut(self._hits(query, doc_type, clamp(top_k, 1, 20)))
        w = G.leaf_words(self.spark, self.graph, h.select(F.col("id").alias("start"), "id"))
        r = h.join(self.graph.select("id", "doc_type", "level", "label"), "id").join(w.select(F.col("start").alias("id"), "words"), "id", "left")
        return self._with_dois(r, include_dois)

    def _cut(self, df: DataFrame):
        from nodeloom.runtime import Scratch

        return Scratch(self.spark, "api").cut(df)

    def context_search(self, query, doc_type: str = "any", top_k: int = 5, max_leaves: int = 40, include_ancestry: bool = True) -> dict[str, DataFrame]:
        """Frames ``hits`` (with their own fields, words cut at max_leaves, and counts of leaves, "at least N" where the walk
        was cut short), ``senses`` (those of a word, or leaf senses of an edge, max_leaves of each hit), ``branches`` of hit
        triads and, shared parts once, ``ancestors`` of the hits with the fields, words or branches of each."""
        h, _ = self._cut(self._hits(query, doc_type, clamp(top_k, 1, 20)))
        cap = clamp(max_leaves, 1, 200)
        most = max(5 * cap, 300)
        own = ("gloss", "tags", "topics", "ipa", "etymology", "forms", "edge_type", "q", "connection_strength", "semantic_label")
        g = self._of(*own, "sense_idx")
        fields = g.select("id", "doc_type", "node_type", "level", "label", "word", "pos", "parent_edge_id", "gloss", "tags", "topics", "ipa", F.when(F.col("etymology") != "", F.substring("etymology", 1, 150)).alias("etymology"),
                          F.slice("forms", 1, 6).alias("forms"), "edge_type", "q", "connection_strength", "semantic_label")
        starts = h.select(F.col("id").alias("start"), "id")
        first = W.partitionBy("start").orderBy("depth", "id")
        l, _ = self._cut(G.leaf_documents(self.spark, self.graph, starts).withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= most + 1))
        cut = F.max("_n") > most
        kept = F.col("_n") <= most

        def counted(kind: str) -> F.Column:
            n = F.sum(F.when(kept & (F.col("node_type") == kind), 1).otherwise(0))
            return F.when(cut, F.concat(F.lit("at least "), n.cast("string"))).otherwise(n.cast("string"))

        n = l.groupBy(F.col("start").alias("id")).agg(counted("sense").alias("sense_count"), counted("word").alias("word_count"))
        w = G.leaf_words(self.spark, self.graph, starts, cap)
        hits = h.join(fields, "id").join(n, "id", "left").join(w.withColumnRenamed("start", "id"), "id", "left")
        by_word = h.join(fields.filter("node_type = 'word'").select("id", "word"), "id").select(F.col("id").alias("hit"), "word")
        of_word = by_word.join(g.filter("node_type = 'sense'").select("word", "id", "pos", "gloss", "sense_idx"), "word").select("hit", "id", "pos", "gloss", "sense_idx")
        of_edge = l.filter("node_type = 'sense' AND start <> id").select(F.col("start").alias("hit"), "id").join(g.select("id", "pos", "gloss", "sense_idx"), "id").select("hit", "id", "pos", "gloss", "sense_idx")
        ranked = of_word.unionByName(of_edge).withColumn("_n", F.row_number().over(W.partitionBy("hit").orderBy("sense_idx", "id")))
        out = {"hits": hits, "senses": ranked.filter(F.col("_n") <= cap).drop("_n"), "branches": G.triad_view(self.spark, self.graph, h)}
        if include_ancestry:
            # the better hit comes first, so it is the one whose chain is written out
            seen = h.select(F.concat_ws("|", F.format_string("%010.6f", F.lit(1.0) - F.col("score")), "id").alias("hit"), "id")
            a, _ = self._cut(G.ancestor_chains(self.spark, self.graph, seen))
            shown = a.filter(~F.col("pointer")).select("id").distinct()
            below = shown.join(self.graph.filter("level >= 14").select("id"), "id", "left_semi")
            words = G.leaf_words(self.spark, self.graph, below.select(F.col("id").alias("start"), "id"), 200).select(F.col("start").alias("id"), F.col("words").alias("leaf_words"), F.col("truncated").alias("leaf_words_truncated"))
            out["ancestors"] = a.join(fields.select("id", "level", "edge_type", "connection_strength", "semantic_label"), "id").join(words, "id", "left")
            out["ancestor_branches"] = G.triad_view(self.spark, self.graph, shown)
        return out

    # lookups

    def find_word(self, word: str) -> DataFrame:
        w = self.graph.filter((F.col("node_type") == "word") & (F.col("word") == word))
        d = G.word_degrees(self.graph, w.select(F.col("id").alias("word_id")))
        return w.select("id", "word", "pos", F.col("parent_edge_id").isNotNull().alias("has_parent")).join(d, F.col("id") == F.col("word_id"), "left").drop("word_id")

    def word_senses(self, word: str, include_dois: bool = False) -> DataFrame:
        """(id, sense_idx, pos, gloss, tags, topics, paired[, dois]) of a word's senses in order of their place."""
        s = self._of("sense_idx", "gloss", "tags", "topics").filter((F.col("node_type") == "sense") & (F.col("word") == word))
        r = s.select("id", "sense_idx", "pos", F.coalesce("gloss", F.lit("")).alias("gloss"), "tags", "topics", F.col("parent_edge_id").isNotNull().alias("paired"))
        return self._with_dois(r, include_dois).orderBy("sense_idx", "id")

    def word_edges(self, word: str, pos: str = "") -> DataFrame:
        w = self.graph.filter((F.col("node_type") == "word") & (F.col("word") == word))
        w = w.filter(F.col("pos") == pos) if pos else w
        return G.edges_of_words(self.graph, w.select(F.col("id").alias("word_id")))

    def edge_info(self, edge_id: str, include_dois: bool = False) -> dict[str, DataFrame]:
        ids = self._ids(edge_id)
        out = {"edge": self._with_dois(self._one(edge_id), include_dois), "branches": G.triad_view(self.spark, self.graph, ids)}
        return out | {"words": G.leaf_words(self.spark, self.graph, ids.select(F.col("id").alias("start"), "id"))}

    def leaf_nodes(self, edge_id: str) -> DataFrame:
        return G.leaf_documents(self.spark, self.graph, self._ids(edge_id).select(F.col("id").alias("start"), "id"))

    def traverse_up(self, edge_id: str, max_levels: int = 6) -> DataFrame:
        """The chain of ancestors with their level, members and bridge."""
        a = G.ancestors(self.spark, self.graph, self._ids(edge_id), max_levels)
        return a.join(self.graph.select("id", "doc_type", "level", "cm1_id", "cm2_id"), "id").join(G.bridges(self.graph), "id", "left").orderBy("step")

    def sample_triads(self, level: int = 13, n: int = 5, seed: int = 0) -> dict[str, DataFrame]:
        """Random triads of a level (10 to 13) with their branches and parents."""
        t = self.graph.filter((F.col("doc_type") != "node") & (F.col("level") == _triad_level(level)))
        t, _ = self._cut(R.sample_rows(t.select("id", "level", "parent_edge_id"), clamp(n, 1, 1000), "id", seed))
        both = t.select("id").union(t.select("parent_edge_id")).filter("id IS NOT NULL").distinct()
        return {"triads": t, "branches": G.triad_view(self.spark, self.graph, both)}

    def graph_stats(self) -> DataFrame:
        return R.breakdown(self.graph).orderBy("doc_type", F.col("level").desc())

    def scan_unlabeled(self, level: int, limit: int = 50, offset: int = 0) -> DataFrame:
        return unlabelled(self.graph, _triad_level(level), clamp(limit, 1, 100), max(0, offset))

    # documents made by hand

    def _add(self, row: DataFrame, vec: DataFrame) -> GraphAPI:
        g = R.upsert(self.graph, row.withColumn("created_at", F.current_timestamp()).withColumn("updated_at", F.current_timestamp()), ["id"])
        return replace(self, graph=g, vectors=R.upsert(self.vectors, vec, ["id"]))

    def create_sense(self, word: str, pos: str, gloss: str, examples: list[str] | None = None, tags: list[str] | None = None, topics: list[str] | None = None) -> tuple[str, GraphAPI]:
        """A sense node, first and only one of its word as far as it knows, with the vector of its gloss and two examples."""
        kind = "word STRING, pos STRING, gloss STRING, examples ARRAY<STRING>, tags ARRAY<STRING>, topics ARRAY<STRING>"
        r = self.spark.createDataFrame([(word, pos, gloss, examples or [], tags or [], topics or [])], kind)
        r = r.withColumn("id", made_id(F.lit("sense"), "word", "pos", "gloss")).withColumn("text", X.embed_text(F.col("gloss"), F.col("examples")))
        new = r.select("id", F.lit("node").alias("doc_type"), F.lit("sense").alias("node_type"), F.lit(15).alias("level"), X.node_label(F.col("word"), F.col("pos"), F.lit(0)).alias("label"), "word", "pos",
                       F.col("id").alias("sense_id"), F.lit(0).alias("sense_idx"), "gloss", "examples", "tags", "topics", F.array().cast("array<string>").alias("wikidata"), F.lit(1).alias("surface"), F.lit(0.0).alias("rotation"))
        return r.first()["id"], self._add(new, r.select("id", embed(F.col("text"), self.options).cast("array<double>").alias("vec")))

    def create_word(self, word: str, pos: str, source_ids: list[str], ipa: str = "", etymology: str = "") -> tuple[str, GraphAPI]:
        """A word node whose vector is the normalised sum of the different sources; raises if a source is unknown."""
        src = self._ids(*sorted(set(source_ids)))
        missing = [r["id"] for r in src.join(self.vectors, "id", "left_anti").collect()]
        if missing or not source_ids:
            raise ValueError(f"unknown sources: {missing}")
        v = src.join(self.vectors, "id").agg(V.normalize(V.vector_sum(F.col("vec"))).alias("vec"))
        none = F.array().cast("array<string>")
        r = self.spark.createDataFrame([(word, pos, ipa, etymology)], "word STRING, pos STRING, ipa STRING, etymology STRING").withColumn("id", made_id(F.lit("word"), "word", "pos"))
        new = r.select("id", F.lit("node").alias("doc_type"), F.lit("word").alias("node_type"), F.lit(14).alias("level"), X.node_label(F.col("word"), F.col("pos")).alias("label"), "word", "pos", "ipa", "etymology",
                       none.alias("forms"), none.alias("sense_ids"), F.lit(len(set(source_ids))).alias("surface"), F.lit(0.0).alias("rotation"))
        return r.first()["id"], self._add(new, r.select("id").crossJoin(v))  # one row each

    def _members(self, *ids: str) -> dict[str, dict]:
        d = self.graph.join(F.broadcast(self._ids(*set(ids))), "id", "left_semi").join(self.vectors, "id").collect()
        found = {r["id"]: r.asDict() for r in d}
        if missing := sorted(set(ids) - set(found)):
            raise ValueError(f"unknown documents: {missing}")
        return found

    def create_edge(self, cm1: str, cm2: str, edge_type: str | None = None, q: float = 0.0) -> tuple[str, GraphAPI]:
        """An edge between two documents of one level; type-neutral with q 1 if no type is named. Members keep their parent."""
        m = self._members(cm1, cm2)
        if cm1 == cm2 or m[cm1]["level"] != m[cm2]["level"]:
            raise ValueError("an edge joins two different documents of one level")
        if edge_type is not None and edge_type not in TYPE_SENTENCES:
            raise ValueError(f"unknown edge type {edge_type}")
        q = q or (self.options.seeds[TYPE_SEEDS[edge_type]] if edge_type else 1.0)
        r = self.spark.createDataFrame([(cm1, cm2, m[cm1]["vec"], m[cm2]["vec"], q, TYPE_SENTENCES.get(edge_type))], "cm1_id STRING, cm2_id STRING, v1 ARRAY<DOUBLE>, v2 ARRAY<DOUBLE>, q DOUBLE, s STRING")
        r, _ = self._cut(r.withColumn("tv", embed(F.col("s"), self.options).cast("array<double>")))
        vec = V.edge_vector(F.col("v1"), F.col("v2"), F.col("tv"), F.col("q")) if edge_type else V.neutral_edge_vector(F.col("v1"), F.col("v2"))
        r = r.withColumn("id", made_id(F.lit(str(m[cm1]["level"])), "cm1_id", "cm2_id"))
        new = r.select("id", F.lit("edge").alias("doc_type"), F.lit(m[cm1]["level"]).alias("level"), "cm1_id", "cm2_id", F.lit(edge_type).cast("string").alias("edge_type"), F.col("tv").alias("type_vector"), "q",
                       F.col("q").alias("connection_strength"), F.col("q").alias("accumulated_weight"), F.lit("ingested").alias("source"), F.lit(1.0).alias("confidence"))
        return r.first()["id"], self._add(new, r.select("id", vec.alias("vec")))

    def create_structural_triad(self, cm1: str, cm2: str, bridge: str, author: str = "") -> tuple[str, GraphAPI, dict]:
        """A triad over two edges of level L and a bridge of level L - 1 that does not own its members.

        The third value reports level, weights, the children's cosine (not enforced) and which members have a parent."""
        signature = author.strip()
        if len(signature) > 200:
            raise ValueError("author must be at most 200 characters")
        m = self._members(cm1, cm2, bridge)
        level = m[cm1]["level"]
        if len({cm1, cm2, bridge}) < 3 or m[cm2]["level"] != level or m[bridge]["level"] != level - 1 or level - 2 < 1:
            raise ValueError("a triad takes two children of one level and a bridge one level below")
        if any(m[x]["doc_type"] == "node" for x in (cm1, cm2, bridge)):
            raise ValueError("members of a triad are edges")
        row = [(cm1, cm2, bridge, *[m[x]["vec"] for x in (cm1, cm2, bridge)], *[float(m[x]["accumulated_weight"] or 0) for x in (cm1, cm2, bridge)])]
        r = self.spark.createDataFrame(row, "cm1_id STRING, cm2_id STRING, bridge_id STRING, v1 ARRAY<DOUBLE>, v2 ARRAY<DOUBLE>, v3 ARRAY<DOUBLE>, w1 DOUBLE, w2 DOUBLE, w3 DOUBLE")
        w = [F.col("w1"), F.col("w2"), F.col("w3")]
        r = r.withColumn("id", made_id(F.lit(str(level - 2)), "cm1_id", "cm2_id", "bridge_id"))
        new = r.select("id", F.lit("edge").alias("doc_type"), F.lit(level - 2).alias("level"), "cm1_id", "cm2_id", "bridge_id", F.lit("structural").alias("source"), F.lit(signature or None).cast("string").alias("author"),
                       V.raw_weight(*w).alias("connection_strength"), V.accumulated_weight(*w, F.lit(level - 2), self.options.level_alpha).alias("accumulated_weight"))
        own = new.select("id", "level", "connection_strength", "accumulated_weight").crossJoin(r.select(F.round(V.cosine(F.col("v1"), F.col("v2")), 4).alias("child_cosine"))).first().asDict()  # one row each
        own |= {f"{name}_parented": bool(m[x]["parent_edge_id"]) for name, x in (("cm1", cm1), ("cm2", cm2), ("bridge", bridge))} | {"author": signature or None}
        return own["id"], self._add(new, r.select("id", V.triad_vector(F.col("v1"), F.col("v2"), F.col("v3"), *w).alias("vec"))), own

    def set_label(self, edge_id: str, label: str, label_vector: list[float], model: str) -> GraphAPI:
        """Write a label over any there is, on an edge of level 13 and below; raises if it can't be."""
        d = self._one(edge_id).select("doc_type", "level").first()
        if d is None or d["doc_type"] == "node" or d["level"] > 13 or len(label_vector) != self.options.dim:
            raise ValueError("labels go on triads and need a vector of the right length")
        g = self.graph
        for c, t in (("semantic_label", "string"), ("label_vector", "array<double>"), ("label_model", "string"), ("label_updated_at", "timestamp")):
            if c not in g.columns:
                g = g.withColumn(c, F.lit(None).cast(t))
        l = self.spark.createDataFrame([(edge_id, label, label_vector, model)], "id STRING, semantic_label STRING, label_vector ARRAY<DOUBLE>, label_model STRING")
        return replace(self, graph=R.write_labels(g, l, self.options.dim, guarded=False))
