"""Stupid-backoff scores of documents under n-gram counts of all the other documents."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_bytes, slices, utf8
from .winnowing import _WORDS_SQL, SLICE, gram_hashes, word_hashes, words_of

ORDER = 3  # words of the longest n-gram
BACKOFF = 0.4
BLOCK_BYTES = 8 << 20  # text of a block of documents
FAN_BITS = 11  # a level cuts the n-grams of an owner in so many pieces (a power of two), at most
FAN_PER_BLOCK = 128  # pieces for each block there is: small tables are cut less
GATHER = (8192, 2048)  # owners whose pieces one count table takes, on the first and on later levels
TASK_BYTES = 64 << 20  # text whose n-grams one shuffle partition takes

_squeeze, _expand = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress


@functools.cache
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def _release() -> None:
    """Give freed memory back to the system. A Python worker lives on when its task has ended, and
    would keep the most it ever held beside the workers of the next stage."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def _planes(values: np.ndarray) -> bytes:
    """64-bit numbers as compressed byte planes."""
    return _squeeze(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T))


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_expand(data), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys, by their differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data), dtype=np.uint64)


def pack_numbers(values: np.ndarray) -> bytes:
    return _planes(np.asarray(values))


def unpack_numbers(data: bytes) -> np.ndarray:
    return _numbers(data).astype(np.int64)


def _lasts(sizes: np.ndarray, n: int) -> np.ndarray:
    """The places of the last words of the n-grams inside documents."""
    ends = np.cumsum(sizes)
    nth = np.arange(ends[-1] if len(ends) else 0)
    nth -= np.repeat(ends - sizes, sizes)
    return np.flatnonzero(nth >= n - 1)


def _ngrams(hashes: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams inside documents, and the place of the last word of each."""
    last = _lasts(sizes, n)
    return gram_hashes(hashes, n)[last - n + 1] if len(last) else np.zeros(0, np.uint64), last


def _cut_blocks(batches, block_bytes: int):
    """(block, ids, sizes, word hashes) of the documents of a partition, block after block.

    A block's number is a hash of its place and content, so that a block is known again.
    """
    base, nth = TaskContext.get().partitionId() << 24, 0
    ids, sizes, hashes, held = [], [], [], 0

    def block():
        n, h = np.concatenate(sizes), np.concatenate(hashes)
        name = xxhash.xxh64(n.astype("<i8").tobytes(), base + nth)
        name.update(np.ascontiguousarray(h, "<u8"))
        return name.intdigest() >> 1, pa.chunked_array(ids).combine_chunks(), n, h

    for batch in batches:
        raw, offsets = utf8(batch.column(1))
        for a, b in slices(offsets, min(SLICE, block_bytes)):
            low, starts, ends, first = words_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            ids.append(batch.column(0).slice(a, b - a))
            sizes.append(np.diff(first))
            hashes.append(word_hashes(low, starts, ends))
            held += int(offsets[b] - offsets[a]) + 16 * (b - a)
            if held >= block_bytes:
                made = block()
                ids, sizes, hashes, held, nth = [], [], [], 0, nth + 1
                yield made
                del made
                _release()
    if ids:
        yield block()
    _release()


def _blocks(source: DataFrame, block_bytes: int) -> DataFrame:
    """Documents of each partition in blocks: ids, words a document, word numbers, vocabulary."""
    id_type = source.schema[0].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("sizes", T.BinaryType()), T.StructField("words", T.BinaryType()), T.StructField("vocab", T.BinaryType())])

    def run(batches):
        for name, ids, sizes, hashes in _cut_blocks(batches, block_bytes):
            vocab, words = np.unique(hashes, return_inverse=True)
            held = [pack_numbers(sizes), pack_numbers(words), pack_sorted(vocab)]
            whole = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([len(words)], pa.int64()), whole, *(pa.array([x], pa.binary()) for x in held)], names=schema.names)

    made = source.mapInArrow(run, schema)
    made._made_from = source, block_bytes
    return made


def _tally(source: DataFrame, block_bytes: int) -> tuple[int, int]:
    """How many blocks there are, and how many words in them."""

    def run(batches):
        for _, _, sizes, _ in _cut_blocks(batches, block_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([int(sizes.sum())], pa.int64())], names=["n"])

    return source.mapInArrow(run, "n long").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()


def _cut(owner: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> pd.DataFrame:
    """Rows (path, owner, keys, counts): ascending keys cut by their first ``bits`` bits."""
    path = (keys >> np.uint64(64 - bits)).astype(np.int64)
    at = np.append(np.flatnonzero(np.diff(path, prepend=-1)), len(keys)).tolist()
    spans = list(zip(at[:-1], at[1:], strict=True))
    return pd.DataFrame({"path": path[at[:-1]], "owner": np.full(len(spans), owner), "keys": [pack_sorted(keys[a:b]) for a, b in spans], "counts": [pack_numbers(counts[a:b]) for a, b in spans]}).astype({"path": "int64", "owner": "int64"})


PIECE = "path long, owner long, keys binary, counts binary"


def exploded(blocks: DataFrame, order: int, bits: int) -> DataFrame:
    """The distinct n-grams of each block of `_blocks`, of all orders, with their counts there:
    PIECE rows. They are made from the documents, in one worker a task, not from the blocks' rows."""
    source, block_bytes = blocks._made_from

    def run(batches):
        for name, _, sizes, hashes in _cut_blocks(batches, block_bytes):
            keys, counts = [], []
            for n in range(1, order + 1):
                k, c = np.unique(_ngrams(hashes, sizes, n)[0], return_counts=True)
                keys.append(k)
                counts.append(c.astype(np.uint32))  # a block has fewer words
            del hashes, k, c
            keys, counts = np.concatenate(keys), np.concatenate(counts)
            by = np.argsort(keys, kind="stable")
            keys, counts = keys[by], counts[by]
            del by
            yield pa.RecordBatch.from_pandas(_cut(name, keys, counts, bits), preserve_index=False)
            del keys, counts

    return source.mapInArrow(run, PIECE)


def _table(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The count table of pieces: ascending keys, counts; and where each piece's keys are in it."""
    keys = [unpack_sorted(k) for k in frame["keys"]]
    table, place = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.bincount(place, weights=np.concatenate([unpack_numbers(c) for c in frame["counts"]]), minlength=len(table)).astype(np.int64)
    return table, counts, place, np.cumsum([len(k) for k in keys]).tolist()


def _dealt(pieces: DataFrame, tasks: int, *by: str) -> DataFrame:
    """More shuffle partitions than the session's, where the size asks for them."""
    return pieces.repartition(tasks, *by) if tasks > int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")) else pieces


def counted(pieces: DataFrame, owners: int, bits: int, gather: tuple[int, ...], tasks: int, level: int = 0) -> DataFrame:
    """(path, owner, keys, counts): every piece with the counts of its n-grams over all owners.

    The count tables are partitioned by the first bits of the n-gram's hash. Where there are more
    owners than one table takes, tables of groups of owners become the owners of the next level,
    cut by the next ``bits`` bits; their answers come back the same way. So a row holds a bounded
    part of an owner, and rows are 2 ** bits an owner and level at most.
    """
    most = gather[min(level, len(gather) - 1)]
    groups = -(-owners // most)

    if groups <= 1:

        def answer(frame: pd.DataFrame) -> pd.DataFrame:
            _, total, place, ends = _table(frame)
            return frame[["path", "owner", "keys"]].assign(counts=[pack_numbers(x) for x in np.split(total[place], ends[:-1])])

        return _dealt(pieces, tasks, "path").groupBy("path").applyInPandas(answer, PIECE)

    shelved = pieces.withColumn("shelf", F.pmod(F.xxhash64("owner"), F.lit(groups)))
    below = min(60, bits * (level + 2))

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        keys, counts, _, _ = _table(frame)
        return _cut(int(frame["shelf"].iloc[0]), keys, counts, below)

    upper = counted(_dealt(shelved, tasks, "path", "shelf").groupBy("path", "shelf").applyInPandas(merge, PIECE), groups, bits, gather, tasks, level + 1)

    def hand_down(frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        told = told.sort_values("path")
        table, total = (np.concatenate([f(x) for x in told[c]]) for c, f in (("keys", unpack_sorted), ("counts", unpack_numbers)))
        return frame[["path", "owner", "keys"]].assign(counts=[pack_numbers(total[np.searchsorted(table, unpack_sorted(k))]) for k in frame["keys"]])

    told = upper.select(F.shiftrightunsigned("path", below - bits * (level + 1)).alias("above"), F.col("owner").alias("shelf"), "path", "keys", "counts")
    return shelved.groupBy("path", "shelf").cogroup(told.groupBy("above", "shelf")).applyInPandas(hand_down, PIECE)


def _own(doc: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
    """How often each place's n-gram occurs in its own document."""
    _, inverse, counts = np.unique(doc * np.int64(max(size, 1)) + place, return_inverse=True, return_counts=True)
    return counts[inverse]


def block_scores(hashes: np.ndarray, sizes: np.ndarray, total: np.ndarray, words_in_all: int, order: int, backoff: float) -> np.ndarray:
    """Log scores of a block's documents. ``total`` holds the counts over all documents of the
    block's distinct n-grams of all orders, ascending by key."""
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    rest = np.maximum(words_in_all - sizes, 0)
    keys, places = [], []
    for n in range(1, order + 1):
        k, place = np.unique(_ngrams(hashes, sizes, n)[0], return_inverse=True)
        keys.append(k)
        places.append(place.astype(np.int32))
    del k, place
    table = np.concatenate(keys)
    table.sort()
    totals = [total[np.searchsorted(table, k)] for k in keys]
    del table, keys, total
    term = below = None
    for n in range(1, order + 1):
        last = _lasts(sizes, n)
        place, counts = places[n - 1], totals[n - 1]
        places[n - 1] = totals[n - 1] = None
        others = np.zeros(len(hashes), np.int64)  # of the n-gram that ends at a place
        if len(last):
            others[last] = counts[place] - _own(doc[last], place, len(counts))
        if n == 1:
            term = np.log(np.where(others > 0, others, 1))
            term -= np.where(others > 0, np.log(np.maximum(rest, 1))[doc], np.log(rest + 1)[doc])
        elif len(last):
            count, context = others[last], below[last - 1]
            seen = (count > 0) & (context > 0)
            found = np.log(np.where(seen, count, 1))
            found -= np.log(np.where(seen, context, 1))
            term[last] = np.where(seen, found, np.log(backoff) + term[last])
        below = others
    return np.bincount(doc, weights=term, minlength=len(sizes))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF, block_bytes: int = BLOCK_BYTES, fan_bits: int = FAN_BITS, gather: tuple[int, ...] = GATHER) -> DataFrame:
    """Score each document by stupid backoff under the n-gram counts of all other documents.

    For n from 2 to ``order``, S(w | context) = c(context w) / c(context) if c(context w) > 0, else
    backoff * S(w | shorter context); S(w) = c(w) / N, or 1 / (N + 1) for a word that no other
    document has. c counts every document but the scored one, N its words. Words are runs of
    letters, digits and non-ASCII characters, lower-cased in A-Z.

    Documents are read in blocks of word numbers. Each block's exploded n-grams, distinct and
    with their counts (the map-side combine, so a frequent n-gram is one entry a block), go by
    hash to the count tables, which add up and join them; answers meet their block, where terms
    are summed per document. Entries travel as ascending arrays of 64-bit hashes and counts, a
    row for each (block, hash range), which take a third of the room of rows of their own; see
    `counted` for how rows stay in proportion to the text. Two n-grams of one hash share a count:
    of N distinct n-grams a share of N / 2**64 does. Blocks are made again for scoring rather
    than stored; should ``docs`` give other rows by then (an input without a fixed order, such
    as an unstaged shuffle), that raises an error.

    Returns doc_id, n_words, log_score (natural logarithm), mean_log_score. Defined cases: null,
    empty and wordless texts have 0 words, log_score 0 and a null mean; repeated rows are other
    documents to each other; null ids pass through; an empty table gives no rows; other columns
    are ignored.
    """
    spark = docs.sparkSession
    arrow_bytes(spark)
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    blocks = _blocks(source, block_bytes)
    owners, words_in_all = _tally(source, block_bytes)
    bits = max(1, min(fan_bits, (FAN_PER_BLOCK * max(1, owners) - 1).bit_length()))
    told = counted(exploded(blocks, order, bits), owners, bits, gather, -(-owners * block_bytes // TASK_BYTES))
    schema = T.StructType([T.StructField("doc_id", source.schema[0].dataType), T.StructField("n_words", T.LongType()), T.StructField("log_score", T.DoubleType())])

    def score(block: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        row = next(block.itertuples())
        hashes, sizes = unpack_sorted(row.vocab)[unpack_numbers(row.words)], unpack_numbers(row.sizes)
        sums = np.zeros(len(sizes))
        if len(hashes) and not len(told):
            raise RuntimeError("documents came in another order when they were read again: stage them first")
        if len(hashes):
            total = np.concatenate([unpack_numbers(c) for c in told.sort_values("path")["counts"]])
            sums = block_scores(hashes, sizes, total, words_in_all, order, backoff)
            del hashes, total
            _release()
        return pd.DataFrame({"doc_id": row.ids, "n_words": sizes, "log_score": sums})

    answers = told.select(F.col("owner").alias("for_block"), "path", "counts")
    scored = blocks.groupBy("block").cogroup(answers.groupBy("for_block")).applyInPandas(score, schema)
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    scored = lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scored.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


ORACLE_SQL = f"""
with d as (select row_number() over () rid, doc_id, {_WORDS_SQL} w from documents),
t as (select rid, unnest(w) x, unnest(generate_series(1, len(w))) i from d),
total as (select count(*) n from t),
p as (select rid, i, x, lag(x) over a v, lag(x, 2) over a u from t window a as (partition by rid order by i)),
c as (select *,
  count(*) over (partition by x) - count(*) over (partition by rid, x) c1,
  count(*) over (partition by v, x) - count(*) over (partition by rid, v, x) c2,
  count(*) over (partition by u, v, x) - count(*) over (partition by rid, u, v, x) c3 from p),
b as (select *, lag(c1) over a b1, lag(c2) over a b2 from c window a as (partition by rid order by i)),
s1 as (select b.*, case when c1 > 0 then ln(c1::double) - ln((n - len(w))::double) else -ln((n - len(w) + 1)::double) end s from b join d using (rid) cross join total),
s2 as (select * exclude (s), case when v is null then s when c2 > 0 and b1 > 0 then ln(c2::double) - ln(b1::double) else ln({BACKOFF}::double) + s end s from s1),
s3 as (select * exclude (s), case when u is null then s when c3 > 0 and b2 > 0 then ln(c3::double) - ln(b2::double) else ln({BACKOFF}::double) + s end s from s2),
sums as (select rid, sum(s) s from s3 group by rid)
select doc_id, len(w)::bigint n_words, round(coalesce(s, 0), 3) log_score, round(s / nullif(len(w), 0), 6) mean_log_score from d left join sums using (rid)
"""
