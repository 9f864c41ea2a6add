"""Visually identical text in one form: equivalence classes under a Unicode collation.

Every distinct value is mapped (look-alikes, widths, invisible characters), and the mapped values are grouped in SQL under
the accent- and case-sensitive collation UNICODE, which holds canonically equivalent spellings for equal. The canonical
member of a class is its mapped value of fewest characters, of equal ones the smallest in binary order, so accents written
apart give way to a composed spelling wherever some member has one; a member whose accents are still apart is composed,
once for its class. It is joined back to all values of the class.

Defined results: null stays null and is never reported; an empty text is its own form; a text of invisible characters
only has the empty form; repeated rows each get a row; the two kinds of text ('word', 'ipa') never share a class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.functions.visual import composed, mapped
from nodeloom.runtime import table

_CLASSES = """
SELECT kind, collate(mapped, 'UNICODE') AS cls, min(struct(char_length(mapped) AS n, mapped)).mapped AS member FROM {m} GROUP BY kind, collate(mapped, 'UNICODE')
"""
_MEMBERS = """
SELECT m.kind, m.value, c.canonical FROM {m} m JOIN {c} c ON m.kind = c.kind AND collate(m.mapped, 'UNICODE') = c.cls
"""


def canonical_members(spark: SparkSession, values: DataFrame) -> DataFrame:
    """(kind, value, canonical) for the distinct values of (kind, value)."""
    distinct = values.filter(F.col("value").isNotNull()).select("kind", "value").distinct()
    form = F.when(F.col("kind") == "ipa", mapped(F.col("value"), "ipa")).otherwise(mapped(F.col("value"), "word"))
    m = distinct.select("kind", "value", form.alias("mapped"))
    c = spark.sql(_CLASSES, m=m).select("kind", "cls", composed(F.col("member")).alias("canonical"))
    return spark.sql(_MEMBERS, m=m, c=c)


def unified(spark: SparkSession, values: DataFrame) -> DataFrame:
    """``values`` (with columns kind and value) and the canonical form of each value."""
    c = canonical_members(spark, values)
    return values.join(c, ["kind", "value"], "left")


def text_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_table, row_id, field, kind, value) of the three columns."""
    parts = [("parsed_words", "word", "word"), ("parsed_words", "ipa", "ipa"), ("sense_relations", "word", "word")]
    out = None
    for t, f, kind in parts:
        x = table(spark, sf_dir, t).select(F.lit(t).alias("src_table"), "row_id", F.lit(f).alias("field"), F.lit(kind).alias("kind"), F.col(f).alias("value"))
        out = x if out is None else out.unionByName(x)
    return out


def disguised_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p2_found``: the values that are not in the consistent form."""
    u = unified(spark, text_values(spark, sf_dir))
    return u.filter(F.col("value") != F.col("canonical")).select("src_table", "row_id", "field")
