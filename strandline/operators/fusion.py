"""Reciprocal-rank fusion of vector, body and path rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import POOL_FACTOR, POOL_LEAST, POOL_MOST, RANK_DIGITS, WEIGHTS, rrf_weight
from ..functions.text import clamp, token_array
from .lexical import QueryTerms, bm25_top, ranked
from .vectors import FEW_QUERIES

BROADCAST_ROWS = 300_000  # candidates that are broadcast, at most


def pool_size(top: int) -> int:
    return clamp(POOL_FACTOR * top, POOL_LEAST, POOL_MOST)


def matching(records: DataFrame, language: str | None = None, source: str | None = None) -> DataFrame:
    """Exact, case-sensitive equality on language and source; None asks for nothing."""
    for name, value in (("language", language), ("source", source)):
        if value is not None:
            records = records.where(F.col(name) == value)
    return records


def fuse(lists: dict[str, DataFrame]) -> DataFrame:
    """Sum of weight / (60 + rank) over the lists a document is in: query_id, id, fused and the
    raw scores that break ties, vector and body (0 where a document is not in the list)."""
    rows = None
    for name, df in lists.items():
        part = df.select("query_id", "id", F.lit(name).alias("list"), "score", rrf_weight(F.col("rank"), WEIGHTS[name]).alias("rrf"))
        rows = part if rows is None else rows.unionByName(part)
    raw = lambda name: F.coalesce(F.max(F.when(F.col("list") == name, F.col("score"))), F.lit(0.0)).alias(name)
    return rows.groupBy("query_id", "id").agg(F.sum("rrf").alias("fused"), raw("vector"), raw("body"), F.max(F.col("list") == "vector").alias("in_vector"))


def hybrid_top(queries: DataFrame, index, top: int = 5, language: str | None = None, source: str | None = None, embedder=None) -> DataFrame:
    """The ``top`` records of each query (query_id, text, and vector unless ``embedder`` makes
    it): record columns, score, rank.

    ``index`` has records, body and path (postings and lengths) and a vector index. The vector list is
    filtered before its top-k; body and path lists are cut to the pool unfiltered, and what does
    not match leaves after fusion, its ranks unfilled. Only ids and scores move until the fused
    candidates, at most three pools a query, fetch their records.
    """
    if top < 0:
        raise ValueError("top must not be negative")
    pool = pool_size(top)
    filtered = language is not None or source is not None
    allowed = matching(index.records, language, source) if filtered else None
    # few queries are fetched once, tokens and vectors together
    local = embedder is not None and hasattr(embedder, "of_tokens") and "vector" not in queries.columns
    if "vector" not in queries.columns:
        queries = queries.withColumn("vector", embedder.column(F.col("text")))
    columns = ["query_id", token_array("text").alias("tokens"), *([] if local else ["vector"])]
    asked = [r.asDict() for r in queries.select(*columns).limit(FEW_QUERIES + 1).collect()]
    if len(asked) <= FEW_QUERIES:
        for r in asked if local else []:
            r["vector"] = embedder.of_tokens(r["tokens"])
        terms = QueryTerms(queries, known=[(r["query_id"], t) for r in asked for t in dict.fromkeys(r["tokens"])])
        nearest = index.vector_index.top(queries, pool, allowed, [r for r in asked if r["vector"] is not None])
    else:
        terms, nearest = QueryTerms(queries), index.vector_index.top(queries, pool, allowed)
    fused = fuse({
        "vector": nearest,
        "body": bm25_top(terms, index.body_postings, index.stats("body"), pool),
        "path": bm25_top(terms, index.path_postings, index.stats("path"), pool),
    })
    # three pools a query bound the candidates; those without a record are dropped
    small = 3 * pool * len(asked) <= BROADCAST_ROWS and len(asked) <= FEW_QUERIES
    found = index.records.join(F.broadcast(fused) if small else fused, "id")
    found = matching(found, language, source)
    order = [F.desc(F.round("fused", RANK_DIGITS)), F.desc(F.round("body", RANK_DIGITS)), F.desc(F.round("vector", RANK_DIGITS)), F.asc("id")]
    best = ranked(found, top, order)
    return best.select("query_id", "rank", "id", "source", "location", "title", "language", "text", F.col("fused").cast("float").alias("score"), "fused")
