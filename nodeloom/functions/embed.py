"""Text embedding behind one contract: a column of texts in, a column of unit vectors out (Arrow batches)."""

from __future__ import annotations

import hashlib
import json
import urllib.request

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from nodeloom.options import Options


def _unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def fake_vector(text: str, dim: int) -> np.ndarray:
    """Deterministic unit vector of a text: the first eight digest bytes, little-endian, seed the generator."""
    seed = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little")
    v = np.random.default_rng(seed).standard_normal(dim).astype(np.float32)
    return v / np.linalg.norm(v)


def embed(texts: Column, options: Options | None = None, batch: int = 16) -> Column:
    """Vectors of ``texts``; null for null. With ``fake_embedder`` no service is asked."""
    o = options or Options.load()
    dim, url, model, fake = o.dim, o.embed_url, o.embed_model, o.fake_embedder

    def run(it):
        for s in it:
            ok = s.notna()
            if fake:
                got = [fake_vector(x, dim) for x in s[ok]]
            else:
                got, texts = [], list(s[ok])
                for a in range(0, len(texts), batch):
                    body = json.dumps({"model": model, "input": texts[a : a + batch]}).encode()
                    with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=120) as r:
                        got += list(_unit_rows(np.asarray(json.load(r)["embeddings"], np.float32)))
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            out[ok] = pd.Series(got, index=s.index[ok], dtype=object)
            yield out

    run.__annotations__ = {}
    from collections.abc import Iterator

    run.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, ArrayType(FloatType()))(texts)
