"""References to records that do not exist: a fixpoint cascade down the foreign-key graph.

Round 0 finds direct orphans: references whose key no record had by the reference's own time. A record all of whose
references stand is sound; a record with an orphaned one is orphaned itself, and whatever refers to it is an inherited
orphan. A key is orphaned once every row that carries it is. Rounds are semi-joins of the next tables down with the newly
orphaned keys; they end when a round orphans nothing new, so loops in the foreign-key graph end too. Keys that many
references share are spread over ``SALTS`` copies of the looked-up record.

Defined results: a null or blank reference is none; a reference without a time is an orphan only if its key never
exists; keys without a time exist always; null keys exist never; repeated rows each count; an empty parent table orphans
every reference; a key without rows in its own table is passed on as soon as a row that claims it is orphaned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.functions.visual import mapped, visual_form
from nodeloom.operators.nested import dictionary_spec, tagged_rows
from nodeloom.runtime import Scratch, table


#: Copies of a record that many references may look up.
SALTS = 8


@dataclass(frozen=True)
class Reference:
    """A foreign key: rows of ``child`` (src_table, row_id, own_key, field, item_idx, ref_key, at) that refer to ``parent`` keys."""

    child: str
    parent: str
    rows: DataFrame


def availability(keys: DataFrame, key: str = "key", since: str = "since") -> DataFrame:
    """One row per key with the first moment it existed (null: always); partial aggregation before the shuffle."""
    k = keys.filter(F.col(key).isNotNull())
    ever = F.max(F.col(since).isNull())
    return k.groupBy(F.col(key).alias("ref_key")).agg(F.min(since).alias("_since"), ever.alias("_ever"))


def _copies() -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("_salt")


def _salted(refs: DataFrame) -> DataFrame:
    return refs.withColumn("_salt", F.pmod(F.xxhash64("row_id", "item_idx"), F.lit(SALTS)))


def direct_orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References of ``refs`` for which ``parents`` (columns of ``availability``) has no key by their time."""
    j = _salted(refs).join(parents.select("*", _copies()), ["ref_key", "_salt"], "left")
    return j.filter(F.col("_ever").isNull() | (~F.col("_ever") & (F.col("at") < F.col("_since")))).drop("_since", "_ever", "_salt")


def cascade(spark: SparkSession, keys: dict[str, DataFrame], references: list[Reference]) -> DataFrame:
    """All orphaned references: ``kind`` 'direct' or 'inherited', ``round`` 0 for direct ones.

    keys: per parent table the frame (key, since) with a row per record of it. A child table that is itself a parent
    passes orphanage on through ``own_key``; every key is passed on once, in the round its last row is orphaned."""
    parents = {p: availability(keys[p]) for p in {r.parent for r in references}}
    found = None
    for r in references:
        o = direct_orphans(r.rows, parents[r.parent]).withColumn("fk_parent", F.lit(r.parent))
        found = o if found is None else found.unionByName(o)
    scratch = Scratch(spark, "cascade")
    parts = [scratch.cut(found.withColumn("kind", F.lit("direct")).withColumn("round", F.lit(0)))[0]]
    passing = sorted({r.child for r in references} & {r.parent for r in references})
    identity = ["src_table", "row_id", "field", "item_idx", "fk_parent"]
    rows = None
    for t in passing:
        n = keys[t].filter(F.col("key").isNotNull()).groupBy(F.lit(t).alias("_t"), F.col("key").alias("ref_key")).agg(F.count(F.lit(1)).alias("_rows"))
        rows = n if rows is None else rows.unionByName(n)
    gone = None
    while passing:
        hurt = _union(parts).filter(F.col("src_table").isin(passing) & F.col("own_key").isNotNull())
        hurt = hurt.groupBy(F.col("src_table").alias("_t"), F.col("own_key").alias("ref_key"), "row_id").agg(F.lit(1).alias("_one"))
        fresh = hurt.groupBy("_t", "ref_key").agg(F.sum("_one").alias("_hurt")).join(rows, ["_t", "ref_key"], "left")
        fresh = fresh.filter(F.col("_hurt") >= F.coalesce("_rows", F.lit(0))).select("_t", "ref_key")
        if gone is not None:
            fresh = fresh.join(gone, ["_t", "ref_key"], "left_anti")
        fresh, c = scratch.cut(fresh, n=F.count(F.lit(1)))
        if not c["n"]:
            break
        gone = fresh if gone is None else gone.unionByName(fresh)
        step = None
        for r in references:
            if r.parent in passing:
                hit = _salted(r.rows).join(fresh.filter(F.col("_t") == r.parent).select("ref_key", _copies()), ["ref_key", "_salt"], "left_semi").drop("_salt")
                hit = hit.withColumn("fk_parent", F.lit(r.parent))
                step = hit if step is None else step.unionByName(hit)
        # a key is passed on once, so a reference can only have been found before as a direct orphan
        step = step.join(parts[0].select(*identity), identity, "left_anti").withColumn("kind", F.lit("inherited")).withColumn("round", F.lit(len(parts)))
        new, c = scratch.cut(step.select(*parts[0].columns), n=F.count(F.lit(1)))
        parts.append(new)
        if not c["n"]:
            break
    return _union(parts)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _reference(src: str, row_id: Column, own: Column, field: Column, idx: Column, key: Column, at: Column) -> list[Column]:
    return [F.lit(src).alias("src_table"), row_id.cast("bigint").alias("row_id"), own.alias("own_key"), field.alias("field"),
            idx.cast("int").alias("item_idx"), key.alias("ref_key"), at.alias("at")]


def _real(df: DataFrame, word: str) -> DataFrame:
    """Rows whose ``word`` is a reference: neither null nor blank once nothing invisible is in it."""
    return df.filter(F.trim(mapped(F.col(word))) != "")


def headwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, since) of all headwords in their visual form."""
    w = table(spark, sf_dir, "parsed_words").filter(F.col("deleted_at").isNull()).select(F.col("word").alias("key"), F.col("parsed_at").alias("since"))
    c = table(spark, sf_dir, "core_words").select(F.col("word").alias("key"), F.col("added_at").alias("since"))
    return w.unionByName(c).withColumn("key", visual_form(F.col("key")))


def word_references(spark: SparkSession, sf_dir: str) -> list[Reference]:
    """References to headwords: relation targets, and the top-level synonyms and antonyms of dictionary lines."""
    null = F.lit(None).cast("string")
    rel = _real(table(spark, sf_dir, "sense_relations"), "word")
    rel = rel.select(*_reference("sense_relations", F.col("row_id"), null, F.lit("word"), F.lit(0), visual_form(F.col("word")), F.col("seen_at")))
    lines = table(spark, sf_dir, "kaikki_lines")
    t = tagged_rows(lines, dictionary_spec("word", ("synonyms", "antonyms")), tags=("synonym", "antonym"), payload=False)
    when = lines.select(F.col("line_id").alias("root"), F.col("loaded_at"))
    t = _real(t, "value").join(when, "root")
    t = t.select(*_reference("kaikki_lines", F.col("root"), null, F.concat("tbl", F.lit("s")), F.col("pos"), visual_form(F.col("value")), F.col("loaded_at")))
    return [Reference("sense_relations", "headwords", rel), Reference("kaikki_lines", "headwords", t)]


def sense_references(spark: SparkSession, sf_dir: str) -> list[Reference]:
    """References that hang below headwords: a sense's own word, and the sense a relation belongs to."""
    s = _real(table(spark, sf_dir, "parsed_senses"), "word")
    s = s.select(*_reference("parsed_senses", F.col("row_id"), F.col("sense_id"), F.lit("word"), F.lit(0), visual_form(F.col("word")), F.col("parsed_at")))
    r = table(spark, sf_dir, "sense_relations").filter(F.trim("sense_id") != "")
    null = F.lit(None).cast("string")
    r = r.select(*_reference("sense_relations", F.col("row_id"), null, F.lit("sense_id"), F.lit(0), F.col("sense_id"), F.col("seen_at")))
    return [Reference("parsed_senses", "headwords", s), Reference("sense_relations", "parsed_senses", r)]


def all_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade over the whole foreign-key graph: headwords, senses, relations and dictionary lines."""
    senses = table(spark, sf_dir, "parsed_senses").select(F.col("sense_id").alias("key"), F.col("parsed_at").alias("since"))
    keys = {"headwords": headwords(spark, sf_dir), "parsed_senses": senses}
    return cascade(spark, keys, word_references(spark, sf_dir) + sense_references(spark, sf_dir))


def missing_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p4_found``: references to headwords that did not exist by the reference's own time, the direct orphans of the
    cascade in relations and dictionary lines."""
    found = all_orphans(spark, sf_dir).filter((F.col("kind") == "direct") & (F.col("fk_parent") == "headwords") & (F.col("src_table") != "parsed_senses"))
    return found.select("src_table", "row_id", "field", "item_idx", F.date_format("at", "yyyy-MM").alias("period"))


def orphan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p4_report``: orphaned references per table, field and month, direct and inherited."""
    found = all_orphans(spark, sf_dir)
    return found.groupBy("src_table", "field", F.date_format("at", "yyyy-MM").alias("period"), "kind").agg(F.count(F.lit(1)).alias("orphans"))
