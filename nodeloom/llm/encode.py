"""Encoding of a corpus with a public byte-level tokenizer by forced-boundary splitting.

A byte pair that occurs inside no token of the vocabulary can never be merged across, so a cut between its bytes is
certain. A text is first cut where a blank follows a non-blank: the tokenizer's own pattern always ends a match there,
and the byte pair is checked to be one of those. The fragments are encoded independently: matched by the pattern, cut at
the remaining certain pairs, merged piece by piece, and concatenated. Fragments repeat all over a corpus, so each
worker keeps the ids of those it has met (``CACHE`` of them, then it starts anew).

Defined results: null and empty texts give an empty list; strings of special tokens are ordinary text; a text of any
length costs time in proportion, as no merge ever spans a certain cut.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.runtime import table

#: Vocabulary file (a parameter) and the largest number of remembered fragments per worker.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE = 200_000
# Fixed value: the public pattern of this vocabulary's tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BLANKS = b" \t\n\r\x0b\x0c"


class FragmentEncoder:
    """Encoder of one vocabulary file."""

    def __init__(self, path: str = RANKS):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        core = getattr(tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={}), "_core_bpe", None)
        # the library's merging of one piece is not part of its public interface
        self.merge = getattr(core, "encode_single_piece", self.merge_plainly)
        self.inside = np.zeros((256, 256), bool)
        for t in self.ranks:
            b = np.frombuffer(t, np.uint8)
            self.inside[b[:-1], b[1:]] = True
        self.flags = self.inside.tobytes()
        blank = "".join(map(re.escape, _BLANKS.decode()))
        # bytes that stand before a blank inside some token: no cut after a character that ends in one of them
        self.joined = frozenset(x for x in range(256) if x not in _BLANKS and any(self.inside[x, w] for w in _BLANKS))
        last = "".join(re.escape(chr(c)) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and chr(c).encode()[-1] in self.joined)
        goes_on = f"(?:(?<=[{last}])[{blank}]+[^{blank}]+)*" if last else ""
        self.cut = re.compile(f"[{blank}]*[^{blank}]+{goes_on}|[{blank}]+")
        # other blanks may share a match with these; such texts, and those beyond 16 bits, are cut more slowly
        self.odd = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\U00010000-\U0010ffff]")
        self.odd_cut = regex.compile(rf"(?<=\S)(?=[{blank}])", regex.V1)
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, list[int]] = {}

    def certain_cuts(self, piece: bytes) -> list[bytes]:
        """``piece`` split at every byte pair that occurs inside no token."""
        if len(piece) < 64:
            inside = self.flags
            at = [i for i in range(1, len(piece)) if not inside[piece[i - 1] << 8 | piece[i]]]
            if not at:
                return [piece]
        else:
            b = np.frombuffer(piece, np.uint8)
            at = (np.flatnonzero(~self.inside[b[:-1], b[1:]]) + 1).tolist()
        ends = [0, *at, len(piece)]
        return [piece[i:j] for i, j in zip(ends, ends[1:])]

    def merge_plainly(self, piece: bytes) -> list[int]:
        """The ids of a piece: the pair of least rank is merged, the first of equal ones, until none is a token."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, len(self.ranks)) for a, b in zip(parts, parts[1:])]
            at = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[at] == len(self.ranks):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fragment(self, text: str) -> list[int]:
        out: list[int] = []
        for m in self.pattern.findall(text):
            piece = m.encode()
            whole = self.ranks.get(piece)
            if whole is not None:
                out.append(whole)
            else:
                for part in self.certain_cuts(piece):
                    out += self.merge(part)
        return out

    def fragments(self, text: str) -> list[str]:
        if not self.odd.search(text):
            return self.cut.findall(text)
        out: list[str] = []
        for f in self.odd_cut.split(text):
            if out and out[-1][-1:].encode()[-1] in self.joined:
                out[-1] += f
            else:
                out.append(f)
        return out

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for f in self.fragments(text):
            got = known.get(f)
            if got is None:
                got = self.fragment(f)
                if len(known) >= CACHE:
                    known.clear()
                if len(f) <= 64:
                    known[f] = got
            out += got
        return out


@lru_cache(4)
def encoder(path: str = RANKS) -> FragmentEncoder:
    return FragmentEncoder(path)


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = RANKS) -> DataFrame:
    """(key, ids) of every row, without a shuffle."""

    def run(batches):
        e = encoder(path)
        for b in batches:
            ids = [e.ids(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return docs.select(F.col(key).cast("bigint"), text).mapInArrow(run, f"{key} BIGINT, ids ARRAY<INT>")


def token_counts(docs: DataFrame, text: str = "text", path: str = RANKS) -> DataFrame:
    """``docs`` without ``text`` but with the number of its tokens (0 for null and empty texts)."""
    keep = [f for f in docs.schema.fields if f.name not in (text, "tokens")]
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["tokens BIGINT"])

    def run(batches):
        e = encoder(path)
        for b in batches:
            n = [len(e.ids(x)) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*b.schema.names[:-1], "tokens"])

    return docs.select(*[f.name for f in keep], text).mapInArrow(run, out)


def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p6_ids``: the token ids of every document."""
    return encoded(table(spark, sf_dir, "documents"))
