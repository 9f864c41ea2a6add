"""Vector algebra as column expressions; arrays of float or double in, arrays of double out, sums in double.

Null vectors give null; a zero vector normalises to itself; vectors of different length give null results.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def scale(v: Column, k: Column) -> Column:
    return F.transform(doubles(v), lambda x: x * k)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def normalize(v: Column) -> Column:
    """Length one; a zero vector is returned unchanged. The norm is computed once per row."""
    parts = F.struct(doubles(v).alias("v"), norm(v).alias("n"))
    return F.transform(F.array(parts), lambda p: F.transform(p["v"], lambda x: F.when(p["n"] > 0, x / p["n"]).otherwise(x)))[0]


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.when(n.isNotNull(), F.lit(0.0)))


def edge_vector(v1: Column, v2: Column, vt: Column, q: Column) -> Column:
    """normalize(q v1 + q v2 + (1 - q) vt)."""
    pair = F.zip_with(doubles(v1), doubles(v2), lambda x, y: q * x + q * y)
    return normalize(F.zip_with(pair, doubles(vt), lambda x, t: x + (1 - q) * t))


def neutral_edge_vector(v1: Column, v2: Column) -> Column:
    return normalize(add(v1, v2))


def level_factor(level: Column, alpha: float = 0.5) -> Column:
    return F.lit(1.0) + F.lit(alpha) * (F.lit(14) - level) / F.lit(13.0)


def raw_weight(w1: Column, w2: Column, w3: Column) -> Column:
    """w3^2 / sqrt(w1^4 + w2^4 + w3^4); 0 if all weights are 0."""
    root = F.sqrt(F.pow(w1, 4) + F.pow(w2, 4) + F.pow(w3, 4))
    return F.when(root > 0, w3 * w3 / root).otherwise(F.lit(0.0))


def triad_vector(v1: Column, v2: Column, vb: Column, w1: Column, w2: Column, w3: Column) -> Column:
    pair = F.zip_with(doubles(v1), doubles(v2), lambda x, y: w1 * x + w2 * y)
    return normalize(F.zip_with(pair, doubles(vb), lambda x, b: x + w3 * b))


def accumulated_weight(w1: Column, w2: Column, w3: Column, level: Column, alpha: float = 0.5) -> Column:
    return raw_weight(w1, w2, w3) * level_factor(level, alpha)


def threshold_floor(level: Column) -> Column:
    """Lowest cosine of the relaxation sweep at a level: round(0.9 - 0.01 level, 2)."""
    return F.round(F.lit(0.9) - F.lit(0.01) * level, 2)


def vector_sum(v: Column) -> Column:
    """Aggregate: sum of vectors of one length, partially aggregated in the JVM."""
    return vector_to_array(Summarizer.sum(array_to_vector(doubles(v))))


def vector_mean(v: Column) -> Column:
    return vector_to_array(Summarizer.mean(array_to_vector(doubles(v))))
