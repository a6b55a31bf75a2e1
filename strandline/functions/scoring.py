"""Scoring formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: BM25 and reciprocal-rank fusion
K1, B = 1.2, 0.75
RRF_K = 60
WEIGHTS = {"vector": 1.0, "body": 1.0, "path": 2.0}
POOL_FACTOR, POOL_LEAST, POOL_MOST = 10, 50, 200
RANK_DIGITS, SHOWN_DIGITS = 9, 6


def idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def bm25_weight(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column) -> Column:
    return idf(n, df) * tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * dl / avgdl))


def rrf_weight(rank: Column, weight: Column | float) -> Column:
    """For a rank from 1."""
    return (F.lit(weight) if isinstance(weight, float) else weight) / (F.lit(float(RRF_K)) + rank)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null if either vector is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)
