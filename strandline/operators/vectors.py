"""Embedding plug-ins and exact top-k by cosine similarity."""

from __future__ import annotations

import hashlib
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import RANK_DIGITS
from ..functions.text import token_array
from .lexical import ranked

FEW_QUERIES = 4096  # query rows that are fetched in one job, at most
QUERY_BYTES = 64 << 20  # query vectors that are sent to the workers at once


class Embedder(Protocol):
    """A text-to-vector plug-in; plug-ins compose by wrapping one another.

    A plug-in that works on tokens may also have ``of_tokens``, which a search uses for the few
    texts it holds on the driver.
    """

    dimensions: int

    def column(self, text: Column) -> Column: ...


class HashingEmbedder:
    """Signed feature hashing of tokens, normalised. It carries lexical similarity, not meaning.

    A token's bucket comes from the first four hex digits of its md5, its sign from the next two.
    """

    light = True  # cheaper than it is to bring equal texts together

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def column(self, text: Column) -> Column:
        dimensions = self.dimensions
        known = _Places(dimensions)

        @F.pandas_udf("array<float>")
        def embed(tokens: pd.Series) -> pd.Series:
            return tokens.map(lambda ts: _signed_sum(known, ts, dimensions))

        return embed(token_array(text))

    def of_tokens(self, tokens: list[str]) -> np.ndarray:
        return _signed_sum(_Places(self.dimensions), tokens, self.dimensions)


class _Places(dict):
    """Token -> 2 * bucket + sign; of one worker, and bounded."""

    def __init__(self, dimensions: int):
        super().__init__()
        self.dimensions = dimensions

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = hashlib.md5(token.encode(), usedforsecurity=False).hexdigest()
        self[token] = place = int(h[:4], 16) % self.dimensions * 2 + int(h[4:6], 16) % 2
        return place


def _signed_sum(known: _Places, tokens, dimensions: int) -> np.ndarray:
    both = np.bincount(np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens)), minlength=2 * dimensions).astype(float)
    v = both[::2] - both[1::2]
    size = np.sqrt((v * v).sum())
    return (v / size if size > 0 else v).astype(np.float32)


class StaticEmbedder:
    """Mean of token rows, normalised: a vocabulary file (a word per line) and a .npy matrix."""

    def __init__(self, vocabulary: str, matrix: str):
        from pathlib import Path

        for path in (vocabulary, matrix):
            if not Path(path).exists():
                raise FileNotFoundError(path)
        self.words = {w: i for i, w in enumerate(Path(vocabulary).read_text(encoding="utf-8").splitlines())}
        self.rows = np.load(matrix).astype(np.float32)
        self.dimensions = self.rows.shape[1]

    def column(self, text: Column) -> Column:
        words, rows = self.words, self.rows

        @F.pandas_udf("array<float>")
        def embed(tokens: pd.Series) -> pd.Series:
            def one(ts):
                known = [words[t] for t in ts if t in words]
                v = rows[known].mean(axis=0) if known else np.zeros(rows.shape[1], np.float32)
                size = np.linalg.norm(v)
                return v / size if size > 0 else v

            return tokens.map(one)

        return embed(token_array(text))


class ColumnEmbedder:
    """Vectors that are there already, in a column."""

    def __init__(self, name: str, dimensions: int):
        self.name, self.dimensions = name, dimensions

    def column(self, text: Column) -> Column:
        return F.col(self.name)


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each distinct text once, with how many rows have it: what an embedder needs to see."""
    return docs.groupBy(text).agg(F.count(F.lit(1)).alias("copies"))


def embed(docs: DataFrame, embedder: Embedder, text: str = "text", key: str = "id", out: str = "embedding") -> DataFrame:
    """(key, out). Equal texts are embedded once: they meet by hash, which is cheaper than a model.

    The text itself is shuffled once, for the grouping; rows come back by its 128-bit digest.
    """
    if isinstance(embedder, ColumnEmbedder):
        return docs.select(key, embedder.column(F.col(text)).alias(out))
    digest = F.md5(F.col(text).cast("binary"))
    once = docs.groupBy(digest.alias("digest")).agg(F.first(text).alias("once"))
    vectors = once.select("digest", embedder.column(F.col("once")).alias(out))
    return docs.select(key, digest.alias("digest")).join(vectors, "digest").select(key, out)


def cosine_top(queries: DataFrame, vectors: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """The k most similar vectors of each query, exactly: query_id, id, score, rank.

    ``queries`` has query_id and vector; ``vectors`` id and embedding. ``allowed`` (id) is applied
    before the top-k, so the list is full of rows that match. Query vectors go out in blocks of
    bounded size; each Arrow batch is one matrix product and gives k rows a query at most.
    """
    asked = queries.where("vector is not null").select("query_id", "vector")
    few = asked.limit(FEW_QUERIES + 1).collect()
    return cosine_top_of(few if len(few) <= FEW_QUERIES else asked.toLocalIterator(), queries, vectors, k, allowed)


def cosine_top_of(asked, queries: DataFrame, vectors: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """`cosine_top` for rows (query_id, vector) that are here already, or come one by one."""
    pool = vectors if allowed is None else vectors.join(allowed.select("id"), "id", "left_semi")
    found = None
    for names, matrix in _query_blocks(asked):
        part = pool.select("id", "embedding").mapInPandas(_searcher(names, matrix, k), "query_id long, id long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = queries.sparkSession.createDataFrame([], "query_id long, id long, score double")
    return ranked(found, k, [F.desc(F.round("score", RANK_DIGITS)), F.asc("id")])


class VectorIndex(Protocol):
    """A vector search plug-in: the ``k`` nearest of each query as query_id, id, score, rank.

    ``queries`` has query_id and vector; ``asked`` is the same as rows, where a search holds them
    already. ``allowed`` (id) is a filter before the cut to ``k``.
    """

    def top(self, queries: DataFrame, k: int, allowed: DataFrame | None = None, asked: list | None = None) -> DataFrame: ...


class ExactVectors:
    """The `VectorIndex` that compares every vector (id, embedding)."""

    def __init__(self, vectors: DataFrame | None):
        self.vectors = vectors

    def top(self, queries: DataFrame, k: int, allowed: DataFrame | None = None, asked: list | None = None) -> DataFrame:
        if asked is None:
            return cosine_top(queries, self.vectors, k, allowed)
        return cosine_top_of(asked, queries, self.vectors, k, allowed)


def _query_blocks(asked):
    names, rows, size = [], [], 0
    for r in asked:
        v = np.array(r["vector"], np.float64)
        names.append(r["query_id"])
        rows.append(v / (np.linalg.norm(v) or 1.0))
        size += v.nbytes
        if size >= QUERY_BYTES:
            yield np.array(names), np.array(rows)
            names, rows, size = [], [], 0
    if names:
        yield np.array(names), np.array(rows)


def _searcher(names: np.ndarray, matrix: np.ndarray, k: int):
    def search(frames):
        for f in frames:
            f = f[f["embedding"].notna()]
            if not len(f):
                continue
            ids, x = f["id"].to_numpy(), np.stack(f["embedding"].to_numpy()).astype(np.float64)
            norms = np.linalg.norm(x, axis=1)
            for a in range(0, len(names), 256):
                scores = (matrix[a : a + 256] @ x.T) / np.where(norms > 0, norms, 1.0)
                for name, s in zip(names[a : a + 256], scores, strict=True):
                    best = np.lexsort((ids, -np.round(s, RANK_DIGITS)))[:k] if len(s) <= 4 * k else _best(s, ids, k)
                    yield pd.DataFrame({"query_id": np.full(len(best), name), "id": ids[best], "score": s[best]})

    return search


def _best(s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    r = np.round(s, RANK_DIGITS)
    near = np.flatnonzero(r >= np.partition(r, len(r) - k)[len(r) - k])
    return near[np.lexsort((ids[near], -r[near]))[:k]]
