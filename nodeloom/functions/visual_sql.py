"""The same consistent form and the same reading of JSON lines as SQL text, to compare results with another engine.

Only the letter tables of ``functions.visual`` are shared; how they are applied is said in SQL."""

from __future__ import annotations

from nodeloom.functions.visual import look_alikes, phonetic, tables
from nodeloom.operators.nested import _ENDS

_FOREIGN = r"'[^\P{L}\p{Latin}\p{Common}\p{Inherited}]'"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _translate(x: str, one: dict[str, str]) -> str:
    one = {k: v for k, v in one.items() if k != "\0"}
    kept = [k for k, v in one.items() if v]
    return f"translate({x}, {_q(''.join(kept + [k for k, v in one.items() if not v]))}, {_q(''.join(one[k] for k in kept))})"


def mapped_sql(x: str, kind: str = "word") -> str:
    one, many = tables() if kind == "word" else phonetic()
    for k, v in many.items():
        x = f"replace({x}, {_q(k)}, {_q(v)})"
    return _translate(x, one)


def form_sql(x: str, kind: str = "word") -> str:
    """``visual_form`` of the SQL expression ``x``."""
    v = mapped_sql(x, kind)
    if kind == "ipa":
        return f"nfc_normalize({v})"
    latin = _translate("t", look_alikes())
    words = f"array_to_string(list_transform(regexp_extract_all(v, '[ -]|[^ -]+'), lambda t: CASE WHEN regexp_matches({latin}, {_FOREIGN}) THEN t ELSE {latin} END), '')"
    return f"(SELECT nfc_normalize({words}) FROM (SELECT {v} AS v))"


def lines_sql() -> str:
    """CTEs of the readable lines: rec (line_id, loaded_at, j)."""
    ends = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(set(_ENDS)) if c != "\0") + "]"

    def strip(x: str) -> str:
        return f"regexp_replace(regexp_replace({x}, '^{ends}+', ''), '{ends}+$', '')"

    return f"""l0 AS (SELECT line_id, loaded_at, {strip('line')} AS t FROM kaikki_lines WHERE line IS NOT NULL),
l1 AS (SELECT line_id, loaded_at, CASE WHEN json_valid(t) AND json_type(t) = 'VARCHAR' THEN {strip("json_extract_string(t, '$')")} ELSE t END AS t FROM l0),
rec AS (SELECT line_id, loaded_at, CAST(t AS JSON) AS j FROM l1 WHERE CASE WHEN json_valid(t) THEN json_type(t) = 'OBJECT' ELSE false END)"""


def items_sql(src: str, of: str, path: str, n: str, keep: str) -> str:
    """Elements of an array, or a lone value, of the JSON column ``of``: keep, position ``n``, element ``e``."""
    a = f"json_extract({of}, '{path}')"
    return f"""(SELECT {keep}, CAST(unnest(generate_series(0, len(l) - 1)) AS INTEGER) AS {n}, unnest(l) AS e FROM (SELECT {keep}, CASE json_type({a}) WHEN 'ARRAY' THEN json_extract({of}, '{path}[*]') WHEN 'NULL' THEN [] ELSE [{a}] END AS l FROM {src} WHERE {a} IS NOT NULL) WHERE len(l) > 0)"""


def value_sql(e: str) -> str:
    """Whether the JSON ``e`` is a value: neither null, nor blank, nor an empty array."""
    text = f"json_extract_string({e}, '$')"
    return f"({e} IS NOT NULL AND CASE json_type({e}) WHEN 'NULL' THEN false WHEN 'VARCHAR' THEN regexp_matches({text}, '[^\\s\\p{{Z}}\\x1c-\\x1f\\x85]') WHEN 'ARRAY' THEN json_array_length({e}) > 0 ELSE true END)"
