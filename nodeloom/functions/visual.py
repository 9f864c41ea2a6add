"""One consistent form of visually identical text, as column expressions.

The form keeps what the eye sees (case, accents, ordinary spaces) and has: one character per accented letter where one
exists, letters of normal width, separate letters instead of ligatures, the plain space and hyphen, nothing invisible,
and Latin letters in words. A word with a letter that no Latin letter looks like is foreign and keeps its letters.
In phonetic text the letters and marks of the phonetic alphabet's chart replace everything that looks like them.

Everything but the final composition is one JVM ``translate``; only values with combining marks visit Python.
Null gives null, an empty text stays empty; a text of invisible characters only becomes empty.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters of other scripts and the Latin letters they look like, position by position.
LOOK_ALIKES = (
    # Cyrillic
    ("АВЕЅІЈКМНОРСТУХѴԚԜԌҮӀаеѕіјорсухѵԛԝԁһӏүёїѐӓӧ", "ABESIJKMHOPCTYXVQWGYIaesijopcyxvqwdhlyëïèäö"),
    # Greek
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϜϹͿανιορυϲϳκχγάίόύ", "ABEZHIKMNOPTYXFCJaviopucjkxyáíóú"),
    # Armenian
    ("ՕՍՏօսոհցզաքյ", "OUSounhgqwfj"),
    # Coptic
    ("ⲀⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥⲓⲕⲩⲭ", "ABEHIKMNOPCTYXopcikyx"),
    # Cherokee
    ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"),
    # Lisu
    ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"),
    # Latin letters of phonetic script in ordinary words
    ("ɑɡ", "ag"),
)

# What looks like a letter or mark of the phonetic chart, and that letter or mark.
PHONETIC_ALIKES = (
    ("gǝɩɷßꞵꭓϐϑϕ", "ɡəɪʊββχβθɸ"),
    ("αειυγφηορνκϲϳ", "ɑɛɪʊɣɸŋopvkcj"),
    ("аеорсхуѕіјһԁԛԝѵӏәӕӡзєө", "aeopcxysijhdqwvləæʒɜɛɵ"),
    ("օսոհցզⲣⲟⲥ", "ounhɡqpoc"),
    ("∫:꞉'ʹ′,’", "ʃːːˈˈˈˌʼ"),
)

# Digraph letters of older phonetic script and the separate letters of the chart.
PHONETIC_DIGRAPHS = {"ʣ": "dz", "ʤ": "dʒ", "ʥ": "dʑ", "ʦ": "ts", "ʧ": "tʃ", "ʨ": "tɕ"}

# Hyphens and short dashes that look like the plain hyphen.
HYPHENS = "‐‑‒–⁃˗−﹘﹣－"

# Blocks whose characters are other widths, styles or joinings of ordinary letters.
COMPAT_RANGES = (
    (0xFF01, 0xFFEE), (0xFB00, 0xFB06), (0x1D400, 0x1D7FF), (0x2160, 0x217F), (0x01C4, 0x01CC), (0x01F1, 0x01F3),
    (0x0132, 0x0133), (0x212A, 0x212B), (0x210A, 0x2113), (0x2118, 0x211D), (0x2124, 0x2124), (0x2128, 0x2128),
    (0x212C, 0x2131), (0x2133, 0x2134),
)

# Format characters that are visible signs, and blank letters that are not format characters.
VISIBLE_FORMAT = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}
BLANK_LETTERS = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0}


@lru_cache(None)
def tables() -> tuple[dict[str, str], dict[str, str]]:
    """(one-to-one or deleting map, one-to-many map) that hold for any text; built from Unicode properties."""
    one: dict[str, str] = {}
    many: dict[str, str] = {}
    for a, b in COMPAT_RANGES:
        for cp in range(a, b + 1):
            c = chr(cp)
            k = unicodedata.normalize("NFKC", c)
            if k != c and unicodedata.category(c) != "Cn":
                (one if len(k) == 1 else many)[c] = k
    for cp in [*range(0x0, 0x20), *range(0x7F, 0x110000)]:
        if 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xE000 or 0x20000 <= cp < 0xE0000:
            continue
        c, cat = chr(cp), unicodedata.category(chr(cp))
        if cat in ("Zs", "Zl", "Zp") or c in "\t\n\x0b\x0c\r\x85":
            one[c] = " "
        elif cat == "Cc" or cat == "Cf" and cp not in VISIBLE_FORMAT or cp in BLANK_LETTERS or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or 0x180B <= cp <= 0x180F:
            one[c] = ""
    one |= dict.fromkeys(HYPHENS, "-")
    return one, many


@lru_cache(None)
def look_alikes() -> dict[str, str]:
    """Non-Latin letter -> the Latin letter it looks like."""
    return {a: b for x, y in LOOK_ALIKES for a, b in zip(x, y, strict=True)}


@lru_cache(None)
def phonetic() -> tuple[dict[str, str], dict[str, str]]:
    """The maps of ``tables`` carried on to the letters of the phonetic chart."""
    own = {a: b for x, y in PHONETIC_ALIKES for a, b in zip(x, y, strict=True)}
    one, many = tables()
    return {c: own.get(k, k) for c, k in one.items()} | {c: k for c, k in own.items() if c not in one}, many | PHONETIC_DIGRAPHS


def _translate(c: Column, one: dict[str, str]) -> Column:
    kept = [k for k, v in one.items() if v]
    return F.translate(c, "".join(kept + [k for k, v in one.items() if not v]), "".join(one[k] for k in kept))


def _expand(c: Column, many: dict[str, str]) -> Column:
    out = c
    for k, v in many.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return F.when(c.rlike("[" + "".join(many) + "]"), out).otherwise(c)


def mapped(c: Column, kind: str = "word") -> Column:
    """``c`` with look-alikes mapped and invisible characters gone, accents not yet composed. kind: 'word' or 'ipa'."""
    if kind == "ipa":
        one, many = phonetic()
        return _translate(_expand(c, many), one)
    one, many = tables()
    v = _translate(_expand(c, many), one)
    latin = F.transform(
        F.split(v, "(?<=[ -])|(?=[ -])"),
        lambda t: F.when(_foreign(_translate(t, look_alikes())), t).otherwise(_translate(t, look_alikes())),
    )
    return F.when(c.rlike("^[ -~]*$"), c).otherwise(F.when(_foreign(v) | v.rlike("[ɑɡ]"), F.array_join(latin, "")).otherwise(v))


def _foreign(c: Column) -> Column:
    return c.rlike(r"[\p{L}&&[^\p{IsLatin}\p{IsCommon}\p{IsInherited}]]")


def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x != x else unicodedata.normalize("NFC", x))


def composed(c: Column) -> Column:
    """Canonical composition; only values with combining marks or jamo are sent to Python."""
    needs = c.rlike(r"[\p{M}ᄀ-ᇿ]")
    return F.coalesce(F.pandas_udf(_nfc, StringType())(F.when(needs, c)), c)


def visual_form(c: Column, kind: str = "word") -> Column:
    """The consistent form of ``c``; kind 'word' for ordinary text, 'ipa' for phonetic text."""
    return composed(mapped(c, kind))
