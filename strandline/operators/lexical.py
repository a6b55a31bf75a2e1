"""BM25: postings, lengths, statistics and ranked search, as joins and aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.scoring import RANK_DIGITS, bm25_weight
from ..functions.text import token_array

FEW_TERMS = 200_000  # query terms that are broadcast, at most
RUN_ROWS, BATCH_ROWS = 4_000_000, 65_536  # postings that a worker sorts at once (about 200 MB), and sends at once
PUSHED_TERMS = 500  # query terms that are a filter of the scan, at most


def by_document(docs: DataFrame, key: str = "id") -> DataFrame:
    """``docs`` hash-partitioned by document, in no fewer partitions than there are cores.

    The text is shuffled once here; term frequencies, lengths and postings, which are larger than
    the text, are then built where they are, because a partitioning by the key serves every
    grouping that holds it.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(max(cores, docs.rdd.getNumPartitions()), key)


def tokenize(docs: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """One row per token: key, pos (from 0), term."""
    return docs.select(key, F.posexplode(token_array(text)).alias("pos", "term"))


def term_frequencies(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keys, term, tf). The only place where text is tokenized; all statistics come from it."""
    return docs.select(*keys, F.explode(token_array(text)).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def lengths(docs: DataFrame, frequencies: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keys, dl) of every document, 0 for those with no token."""
    dl = frequencies.groupBy(*keys).agg(F.sum("tf").alias("dl"))
    return docs.select(*keys).join(dl, list(keys), "left").select(*keys, F.coalesce("dl", F.lit(0)).cast("long").alias("dl"))


def lengths_of(docs: DataFrame, found: DataFrame) -> DataFrame:
    """`lengths` from stored postings, where each has its document's length: no text is read."""
    dl = found.groupBy("id").agg(F.max("dl").alias("dl"))
    return docs.select("id").join(dl, "id", "left").select("id", F.coalesce("dl", F.lit(0)).cast("long").alias("dl"))


def build(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("id",)) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of documents with columns ``keys`` (id, and what it is partitioned by)
    and ``text``. Postings are (term, keys, tf, dl): the length travels with the posting, so a
    search joins nothing else. With ``docs`` partitioned by the first key nothing is shuffled."""
    tf = term_frequencies(docs, text, keys)
    dl = F.sum("tf").over(Window.partitionBy(*keys))
    return tf.withColumn("dl", dl).select("term", *keys, "tf", "dl"), lengths(docs, tf, keys)


def postings_in_place(docs: DataFrame, tokens: Column, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """The postings of `build`, of documents of which no two have the same keys: terms are counted
    in the row that holds them, and nothing is shuffled. Each partition is sorted by term, in runs
    of RUN_ROWS: numbers stand for the terms, which is cheaper than to sort rows of strings."""
    kinds = {f.name: f for f in docs.select(*keys).schema.fields}
    schema = T.StructType([T.StructField("term", T.StringType()), *(kinds[k] for k in keys), T.StructField("tf", T.LongType()), T.StructField("dl", T.LongType())])

    def counted(batch) -> tuple:
        found = batch.column(len(keys))
        n = found.value_lengths().to_numpy().astype(np.int64)
        coded = found.flatten().dictionary_encode()
        size = np.int64(max(len(coded.dictionary), 1))
        pairs, tf = np.unique(np.repeat(np.arange(len(n)), n) * size + coded.indices.to_numpy(), return_counts=True)
        row, term = np.divmod(pairs, size)
        at = pa.array(row)
        return pa.DictionaryArray.from_arrays(pa.array(term, pa.int32()), coded.dictionary), *(batch.column(i).take(at) for i in range(len(keys))), pa.array(tf.astype(np.int64)), pa.array(n[row])

    def ordered(held: list[tuple]):
        first, *others = (pa.chunked_array(x) for x in zip(*held, strict=True))
        same = first.unify_dictionaries()
        terms = same.chunk(0).dictionary
        rank = np.empty(len(terms), np.int32)
        up = pc.array_sort_indices(terms)
        rank[up.to_numpy()] = np.arange(len(terms), dtype=np.int32)
        ranks = np.concatenate([rank[c.indices.to_numpy()] for c in same.chunks])
        terms, by = terms.take(up), np.argsort(ranks, kind="stable")
        others = [x.combine_chunks() for x in others]
        for a in range(0, len(by), BATCH_ROWS):
            part = by[a : a + BATCH_ROWS]
            at = pa.array(part)
            yield pa.RecordBatch.from_arrays([terms.take(pa.array(ranks[part])), *(x.take(at) for x in others)], names=schema.names)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(counted(batch))
            n += len(held[-1][0])
            if n >= RUN_ROWS:
                yield from ordered(held)
                held, n = [], 0
        if n:
            yield from ordered(held)

    return docs.select(*keys, tokens.alias("tokens")).mapInArrow(run, schema)


def document_frequencies(found: DataFrame) -> DataFrame:
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def collection_stats(doc_lengths: DataFrame) -> DataFrame:
    """One row: n (documents, empty ones too), total (their tokens)."""
    return doc_lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"))


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, term), each term once: how often a query repeats a term does not count."""
    return queries.select("query_id", F.explode(F.array_distinct(token_array(text))).alias("term")).distinct()


def ranked(scores: DataFrame, k: int, order: list, by: str = "query_id") -> DataFrame:
    """Rank from 1 inside each query, the best k. The window over a real key lets Spark cut each
    partition to k rows before the shuffle."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


class QueryTerms:
    """The terms of a query table: held here while few, a DataFrame with no bound otherwise."""

    def __init__(self, queries: DataFrame, text: str = "text", known: list[tuple] | None = None):
        """``known``: the (query_id, term) pairs, if they are here already."""
        self.table = query_terms(queries, text)
        rows = self.table.limit(FEW_TERMS + 1).collect() if known is None else known
        self.few = len(rows) <= FEW_TERMS
        if self.few:
            local = pa.table({"query_id": pa.array([r[0] for r in rows], pa.int64()), "term": pa.array([r[1] for r in rows], pa.string())})
            self.table = F.broadcast(queries.sparkSession.createDataFrame(local))
            self.distinct = sorted({r[1] for r in rows})

    def postings(self, found: DataFrame) -> DataFrame:
        """The postings of these terms: a filter that reaches the scan, or a semi-join."""
        if self.few and len(self.distinct) <= PUSHED_TERMS:
            return found.where(F.col("term").isin(self.distinct))
        return found.join(self.table.select("term").distinct(), "term", "left_semi")


def bm25_scores(terms: QueryTerms, found: DataFrame, stats: tuple[int, int]) -> DataFrame:
    """(query_id, id, score) of all documents with a query term; ``stats`` is (n, total).

    Few query terms are broadcast, and with them their document frequencies, no more rows; then
    postings, however skewed by frequent terms, stay where they are and only (query, document)
    partial sums are shuffled. With more, Spark joins by term.
    """
    n, total = stats
    hits = terms.postings(found)
    df = document_frequencies(hits)
    df = F.broadcast(df) if terms.few else df
    weight = bm25_weight(F.col("tf").cast("double"), F.col("dl"), F.col("df"), F.lit(n), F.lit(total / n if n else 1.0))
    weighed = hits.join(df, "term").select("term", "id", weight.alias("w"))
    return weighed.join(terms.table, "term").groupBy("query_id", "id").agg(F.sum("w").alias("score"))


def bm25_top(terms: QueryTerms, found: DataFrame, stats: tuple[int, int], k: int) -> DataFrame:
    """The k best documents of each query: query_id, id, score, rank; ties to the smaller id."""
    return ranked(bm25_scores(terms, found, stats), k, [F.desc(F.round("score", RANK_DIGITS)), F.asc("id")])


def stats_of(doc_lengths: DataFrame) -> tuple[int, int]:
    row = collection_stats(doc_lengths).first()
    return row["n"], row["total"]
