"""Text, id and relation functions of the dictionary pipeline as column expressions. Null in, null out unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nodeloom.operators.nested import RELATIONS

# Texts that stand for a missing identifier of a document.
NO_DOI = ("(no doi)", "no doi", "n/a", "none")


def embed_text(gloss: Column, examples: Column) -> Column:
    """Gloss and the first two examples, joined by blanks and trimmed."""
    return F.trim(F.concat_ws(" ", F.array(gloss), F.slice(F.coalesce(examples, F.array().cast("array<string>")), 1, 2)))


def sense_id(raw: Column, word: Column, pos: Column, idx: Column) -> Column:
    """The given id, else word-pos-index."""
    return F.coalesce(F.when(raw != "", raw), F.concat_ws("-", word, pos, idx.cast("string")))


def term_sense_id(doi: Column, term_id: Column, gloss: Column) -> Column:
    """batch:doi:id, or with no doi batch:nodoi:id:hash of the gloss, so equal ids of different sources stay apart."""
    return F.when(doi.isNotNull(), F.concat_ws(":", F.lit("batch"), doi, term_id)).otherwise(
        F.concat_ws(":", F.lit("batch"), F.lit("nodoi"), term_id, F.substring(F.sha1(gloss), 1, 10))
    )


def normalize_term(term: Column) -> Column:
    """Trimmed, runs of blanks to one blank, case kept."""
    return F.trim(F.regexp_replace(term, r"\s+", " "))


def normalize_doi(doi: Column) -> Column:
    t = F.trim(doi)
    return F.when((t != "") & ~F.lower(t).isin(*NO_DOI), t)


def parse_weights(text: Column) -> Column:
    """Integers of a blank-separated text, 0 for what is none; an empty array for null or blank."""
    parts = F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")
    return F.coalesce(F.transform(parts, lambda x: F.coalesce(x.try_cast("int"), F.lit(0))), F.array().cast("array<int>"))


def argmax_weight(weights: Column) -> Column:
    """Position of the first largest weight if any is above 0, else null."""
    top = F.array_max(weights)
    return F.when(top > 0, F.array_position(weights, top).cast("int") - 1)


def node_label(word: Column, pos: Column, idx: Column | None = None) -> Column:
    base = F.concat(word, F.lit(" ("), pos, F.lit(")"))
    return base if idx is None else F.concat(base, F.lit(" ["), idx.cast("string"), F.lit("]"))


def _part(word: Column, antonyms: Column, synonyms: Column) -> Column:
    groups = F.concat_ws(
        "; ",
        F.when(F.size(antonyms) > 0, F.concat(F.lit("antonyms: "), F.array_join(antonyms, ", "))),
        F.when(F.size(synonyms) > 0, F.concat(F.lit("synonyms: "), F.array_join(synonyms, ", "))),
    )
    return F.when(groups != "", F.concat(word, F.lit(" ("), groups, F.lit(")"))).otherwise(word)


def edge_type_text(word_a: Column, ant_a: Column, syn_a: Column, word_b: Column, ant_b: Column, syn_b: Column) -> Column:
    """``A (antonyms: …; synonyms: …); B (…)``; a bare word if it has no neighbours."""
    return F.concat_ws("; ", _part(word_a, ant_a, syn_a), _part(word_b, ant_b, syn_b))


def relation_list(record: dict[str, Column]) -> Column:
    """All relations of a record as (kind, word, dis1) in the fixed order of kinds, those without a word left out."""
    def of(kind: str) -> Column:
        has = F.filter(F.coalesce(record[kind], F.array().cast("array<struct<word:string,_dis1:string>>")), lambda r: r["word"].isNotNull() & (r["word"] != ""))
        return F.transform(has, lambda r: F.struct(F.lit(kind).alias("kind"), r["word"].alias("word"), parse_weights(r["_dis1"]).alias("dis1")))

    parts = [of(k) for k in RELATIONS]
    return F.concat(*parts)


def form_list(forms: Column) -> Column:
    return F.filter(F.transform(forms, lambda f: f["form"]), lambda x: x.isNotNull() & (x != ""))


def first_ipa(sounds: Column) -> Column:
    """The first sound script without tags, else the first one."""
    has = F.filter(sounds, lambda s: s["ipa"].isNotNull() & (s["ipa"] != ""))
    plain = F.filter(has, lambda s: s["tags"].isNull() | (F.size(s["tags"]) == 0))
    return F.coalesce(F.get(plain, F.lit(0))["ipa"], F.get(has, F.lit(0))["ipa"])


def surface(sense_ids: Column) -> Column:
    return F.greatest(F.lit(1), F.size(F.coalesce(sense_ids, F.array().cast("array<string>"))))


def semantic_label(candidates_text: Column) -> Column:
    """The label of 3 to 200 characters in a labelling answer, else null."""
    x = F.get_json_object(candidates_text, "$.semantic_label")
    t = F.trim(x)
    return F.when(F.length(t).between(3, 200), t)


def first_words(words: Column, n: int = 10) -> Column:
    return F.array_join(F.slice(words, 1, n), ", ")


def resolve_sense(weights: Column, best: Column, best_cosine: Column, threshold: float = 0.72) -> Column:
    """Sense position: the largest weight if any is above 0, else the nearest sense from ``threshold`` on, else null."""
    return F.coalesce(argmax_weight(weights), F.when(best_cosine >= threshold, best))
