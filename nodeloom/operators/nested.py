"""Deeply nested records to related flat tables by single-pass tagged emission.

A depth-first visitor walks every JSON record once and emits one row per nested element, tagged with the table it
belongs to and carrying its own key, its parent's key and its payload. Keys are paths (``17/senses/0/glosses/1``), so
they are unique, need no coordination between tasks, and a child's key is an extension of its parent's.

Defined results: null, empty, damaged and non-object lines give no rows; a JSON string that holds an object is
unwrapped; blank and invisible characters at either end are ignored; a lone value where an array is meant is element 0;
null elements give no row but count in positions; with repeated keys the last one holds; a bare value where an object
is meant becomes the field named in ``bare``; records may be nested to any depth. Extra columns of the input are not read.
"""

from __future__ import annotations

import json
import re
import sys
from dataclasses import dataclass, field
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.functions.visual import tables
from nodeloom.runtime import Scratch, table

#: Levels of nesting whose values keep their structure in a record nested beyond the interpreter's stack.
DEEP = 100
#: Blank and invisible characters, which do not count at the ends of a line.
_ENDS = " " + "".join(c for c, to in tables()[0].items() if to in ("", " "))


@dataclass(frozen=True)
class Child:
    """One nested array: ``tag`` of its table, ``value`` the field that holds an element's main value ('' if elements are
    values themselves), ``bare`` the field a bare value stands for (None: such elements have no fields)."""

    tag: str
    value: str = ""
    bare: str | None = None
    children: dict[str, Child] = field(default_factory=dict)


RELATIONS = ("antonyms", "meronyms", "holonyms", "hypernyms", "hyponyms", "derived", "related", "coordinate_terms", "synonyms")


def dictionary_spec(relation_value: str = "word", relations: tuple[str, ...] = RELATIONS) -> dict[str, Child]:
    """Nesting of a dictionary record; ``relation_value`` is the main field of relation elements."""
    rel = {r: Child(r[:-1] if r.endswith("s") else r, relation_value, "word") for r in relations}
    sense = {"glosses": Child("gloss"), "examples": Child("example", "text", "text")} | {r: Child(f"sense_{c.tag}", c.value, c.bare) for r, c in rel.items()}
    return {"senses": Child("sense", "id", None, sense), "sounds": Child("sound", "ipa", "ipa"), "forms": Child("form", "form", "form")} | rel


TAGGED = "root BIGINT, tbl STRING, pk STRING, parent_pk STRING, pos INT, parent_pos INT, value STRING, payload STRING"


def _constant(x: str):
    raise ValueError(x)


_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?")
_WORDS = {"true": True, "false": False, "null": None}
_BLANK = re.compile(r"[ \t\n\r]*")


def _deep(text: str):
    """``json.loads`` with a stack of its own, for texts nested beyond the interpreter's; None if damaged. What lies deeper
    than ``DEEP`` levels is kept as its JSON text."""
    stack: list[tuple] = []  # (container, its beginning), with the key in waiting
    keys: list[str | None] = []
    i = _BLANK.match(text).end()
    try:
        while True:
            c, value, opened = text[i], None, False
            if c in "{[":
                stack.append(({} if c == "{" else [], i))
                keys.append(None)
                i = _BLANK.match(text, i + 1).end()
                opened = text[i] not in "}]"
                if not opened and (text[i] == "}") != (c == "{"):
                    return None
            elif c == '"':
                value, i = scanstring(text, i + 1, True)
            elif (m := _NUMBER.match(text, i)) is not None:
                value, i = (float if m[1] or m[2] else int)(m[0]), m.end()
            else:
                word = next((w for w in _WORDS if text.startswith(w, i)), None)
                if word is None:
                    return None
                value, i = _WORDS[word], i + len(word)
            closing = not opened and c in "{["
            while not opened:  # a value is complete: close what ends here, else go on to the next one
                if closing:
                    value, start = stack.pop()
                    keys.pop()
                    i += 1
                    if len(stack) >= DEEP:
                        value = text[start:i]
                i = _BLANK.match(text, i).end()
                if not stack:
                    return value if i == len(text) else None
                top = stack[-1][0]
                if isinstance(top, dict):
                    top[keys[-1]] = value
                else:
                    top.append(value)
                closing = text[i] == ("}" if isinstance(top, dict) else "]")
                if not closing:
                    if text[i] != ",":
                        return None
                    i = _BLANK.match(text, i + 1).end()
                    break
            if isinstance(stack[-1][0], dict):
                if text[i] != '"':
                    return None
                keys[-1], i = scanstring(text, i + 1, True)
                i = _BLANK.match(text, i).end()
                if text[i] != ":":
                    return None
                i = _BLANK.match(text, i + 1).end()
    except (IndexError, ValueError):
        return None


def read_record(line: str | None) -> dict | None:
    """The object a line holds, or None."""
    if line is None:
        return None
    text = line.strip(_ENDS)
    for _ in range(2):
        try:
            got = json.loads(text, parse_constant=_constant)
        except ValueError:
            return None
        except RecursionError:
            got = _deep(text)
        if isinstance(got, dict):
            return got
        if not isinstance(got, str):
            return None
        text = got.strip(_ENDS)
    return None


def _clean(x: str) -> str:
    return x if x.isascii() else x.encode("utf-8", "replace").decode("utf-8")


def main_value(v) -> str | None:
    """Text of a value that is neither null, blank nor an empty array; None otherwise. Strings as they are, others as JSON."""
    if v is None or v == []:
        return None
    if isinstance(v, str):
        return _clean(v) if v.strip() else None
    return json.dumps(v, ensure_ascii=True)


def visit(root: int, record: dict, spec: dict[str, Child], wanted: frozenset[str] | None, payload: bool):
    """Depth-first over one record, with an explicit stack; yields the rows of ``TAGGED``."""
    key = str(root)
    if wanted is None or "record" in wanted:
        own = {k: v for k, v in record.items() if k not in spec}
        yield root, "record", key, None, 0, None, main_value(record.get("word")), _clean(json.dumps(own, ensure_ascii=False)) if payload else None
    stack = [(key, 0, record, spec)]
    while stack:
        parent, at, obj, nest = stack.pop()
        for name, child in nest.items():
            found = obj.get(name)
            if found is None:
                continue
            for i, x in enumerate(found if isinstance(found, list) else (found,)):
                if x is None:
                    continue
                if child.value or child.children:
                    if not isinstance(x, dict):
                        if child.bare is None or isinstance(x, list):
                            continue
                        x = {child.bare: x}
                    value = main_value(x.get(child.value))
                    rest = {k: v for k, v in x.items() if k not in child.children} if payload else None
                else:
                    value, rest = main_value(x), x
                pk = f"{parent}/{name}/{i}"
                if wanted is None or child.tag in wanted:
                    yield root, child.tag, pk, parent, i, at, value, _clean(json.dumps(rest, ensure_ascii=False)) if payload else None
                if child.children:
                    stack.append((pk, i, x, child.children))


def tagged_rows(lines: DataFrame, spec: dict[str, Child] | None = None, *, key: str = "line_id", line: str = "line",
                tags: tuple[str, ...] | None = None, payload: bool = True) -> DataFrame:
    """All nested elements of ``lines`` as tagged rows (schema ``TAGGED``), in one pass and without a shuffle.

    tags limits the emitted tables (None: all). payload=False leaves out the JSON of each element's own fields."""
    spec = spec if spec is not None else dictionary_spec()
    wanted = frozenset(tags) if tags else None

    def run(batches):
        sys.set_int_max_str_digits(0)
        for b in batches:
            rows = []
            for root, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rec = read_record(text)
                if rec is not None and root is not None:
                    rows.extend(visit(root, rec, spec, wanted, payload))
                if len(rows) >= 20_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return lines.select(F.col(key).cast("bigint").alias("root"), F.col(line).alias("line")).mapInArrow(run, TAGGED)


_ARROW = pa.schema([("root", pa.int64()), ("tbl", pa.string()), ("pk", pa.string()), ("parent_pk", pa.string()),
                    ("pos", pa.int32()), ("parent_pos", pa.int32()), ("value", pa.string()), ("payload", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


def write_tables(tagged: DataFrame, path: str) -> None:
    """Write tagged rows once, partitioned by table."""
    tagged.write.mode("overwrite").partitionBy("tbl").parquet(path)


def read_table(spark, path: str, tag: str, schema: str) -> DataFrame:
    """One flat table of ``write_tables``: keys, position ``at`` and the parent's ``parent_at``, main value and the typed
    columns of ``schema``; only that table's partition is read."""
    t = spark.read.schema(TAGGED).parquet(path).filter(F.col("tbl") == tag)
    own = ["pk", "parent_pk", "root", F.col("pos").alias("at"), F.col("parent_pos").alias("parent_at"), "value"]
    return t.withColumn("f", F.from_json("payload", schema)).select(*own, "f.*") if schema else t.select(*own)


#: The flat tables of a dictionary record and the typed columns of each beside its keys, positions and main value.
FLAT_TABLES = {
    "record": "word STRING, pos STRING, lang_code STRING, etymology_text STRING", "sense": "id STRING, tags ARRAY<STRING>, topics ARRAY<STRING>", "gloss": "",
    "example": "text STRING", "sound": "ipa STRING, tags ARRAY<STRING>", "form": "form STRING, tags ARRAY<STRING>", "synonym": "word STRING", "sense_synonym": "word STRING",
}


def flat_tables(spark: SparkSession, lines: DataFrame, relation_value: str = "_dis1") -> dict[str, DataFrame]:
    """The related flat tables of dictionary lines: visited and written once, partitioned by table, and read by schema."""
    path = Scratch(spark, "nested").root
    write_tables(tagged_rows(lines, dictionary_spec(relation_value, ("synonyms",))), path)
    return {tag: read_table(spark, path, tag, schema) for tag, schema in FLAT_TABLES.items()}


def nested_values(lines: DataFrame) -> DataFrame:
    """``p1_found``: the place of every gloss, example, sound and synonym weight that is neither null nor blank."""
    t, out = flat_tables(lines.sparkSession, lines), None
    for tag in ("gloss", "example", "sound", "synonym"):
        inner = tag in ("gloss", "example")
        at = [F.col("parent_at"), F.col("at")] if inner else [F.col("at"), F.lit(-1)]
        one = t[tag].filter(F.col("value").isNotNull()).select(F.col("root").alias("line_id"), F.lit(tag).alias("tbl"), at[0].cast("int").alias("i"), at[1].cast("int").alias("j"))
        out = one if out is None else out.unionByName(one)
    return out


def sense_glosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p1_glosses``: every gloss with its sense and record, found by following the parents' keys."""
    t = flat_tables(spark, table(spark, sf_dir, "kaikki_lines"))
    s = t["sense"].select(F.col("pk").alias("sense_pk"), F.col("parent_pk").alias("record_pk"), F.col("id").alias("sense_id"), F.col("at").alias("i"))
    r = t["record"].select(F.col("pk").alias("record_pk"), F.col("root").alias("line_id"), "word")
    g = t["gloss"].select(F.col("parent_pk").alias("sense_pk"), F.col("at").alias("j"), F.col("value").alias("gloss"))
    return g.join(s, "sense_pk").join(r, "record_pk").select("line_id", "i", "j", "sense_id", "word", "gloss")
