"""Hierarchical packing of documents into sequences of several context sizes."""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_bytes
from .tokens import word_bpe

TIERS = (256, 512, 1024, 2048)
END_ID = 1
BLOCK_TOKENS, BLOCK_DOCS = 2_000_000, 50_000  # a block is packed when it has so many tokens or documents
STEP_TOKENS = 131_072  # tokens of a step group


def fill(pieces: list[tuple[int, int, int]], tiers: tuple[int, ...], last: bool):
    """Pack (length, document, start) pieces; returns (full sequences, pieces left for later).

    A piece goes to the tier that is the smallest window holding it; longer ones give whole
    largest windows first. From the largest tier down, each window takes one piece of its tier
    and its gap takes the longest waiting pieces that fit whole, whatever their tier; when none
    fits, the shortest waiting piece is cut. What cannot fill a window waits for the next block,
    and with ``last`` is cut at powers of two.
    """
    top, done, pool = tiers[-1], [], []
    for length, doc, start in pieces:
        whole = length // top
        done += [[(top, doc, start + i * top)] for i in range(whole)]
        if length % top:
            pool.append((length % top, doc, start + whole * top))
    pool.sort()

    def window(first, size):
        got, gap = [first], size - first[0]
        while gap and pool:
            at = bisect_right(pool, (gap, float("inf"), 0)) - 1
            if at >= 0:
                piece = pool.pop(at)
            else:
                length, doc, start = pool.pop(0)
                piece = (gap, doc, start)
                insort(pool, (length - gap, doc, start + gap))
            got.append(piece)
            gap -= piece[0]
        return got, gap

    for size, below in zip(tiers[::-1], [*tiers[-2::-1], 0], strict=True):
        while (at := bisect_left(pool, (below + 1, -1, 0))) < len(pool):
            got, gap = window(pool.pop(), size)
            if not gap:
                done.append(got)
                continue
            if not last:
                return done, got + pool
            rest = got
            for k in range(size.bit_length() - 1, -1, -1):
                if sum(p[0] for p in rest) >= 1 << k:
                    cut, room = [], 1 << k
                    while room:
                        length, doc, start = rest.pop(0)
                        cut.append((min(length, room), doc, start))
                        if length > room:
                            rest.insert(0, (length - room, doc, start + room))
                        room -= cut[-1][0]
                    done.append(cut)
    return done, pool


def step_groups(lengths: list[int], step: int) -> list[int]:
    """A group for each sequence: longest first, each to the group with the fewest tokens."""
    groups = [(0, g) for g in range(max(1, -(-sum(lengths) // step)))]
    out = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        tokens, g = heapq.heappop(groups)
        out[i] = g
        heapq.heappush(groups, (tokens + lengths[i], g))
    return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Tokenize whole documents and pack them, without a shuffle: one row per piece.

    Each input partition is packed by itself in bounded blocks; unfilled windows carry over to
    the next block, so only the end of a partition has short sequences, cut at powers of two.
    sequence_id and step_group are the partition number (upper 32 bits) and a local number. A
    step group has nearly equal tokens and a mix of tiers.

    Returns doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id,
    offset, tier (window size), step_group, doc_row (the document's row in its partition, which
    tells repeated ids apart). Defined cases: a null or empty text is one end id; texts of any
    length are cut into windows; null ids pass through; no rows give no rows; other columns are
    ignored.
    """
    arrow_bytes(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([
        T.StructField("doc_id", source.schema[0].dataType), *(T.StructField(n, T.LongType()) for n in ("start", "length")), T.StructField("ids", T.BinaryType()),
        *(T.StructField(n, T.LongType()) for n in ("doc_tokens", "sequence_id", "offset", "tier", "step_group", "doc_row")),
    ])

    def run(batches):
        encoder, base = word_bpe(tokenizer), TaskContext.get().partitionId() << 32
        kept: dict[int, tuple] = {}  # row -> (id, ids), of documents with pieces that wait
        waiting: list[tuple[int, int, int]] = []
        fresh, row, since, sequence, group, kind = 0, 0, 0, 0, 0, None

        def flush(last):
            nonlocal waiting, fresh, sequence, group
            full, waiting = fill(waiting, tiers, last)
            lengths = [sum(p[0] for p in s) for s in full]
            steps = step_groups(lengths, step_tokens)
            rows = []
            for s, (pieces, used, g) in enumerate(zip(full, lengths, steps, strict=True)):
                offset = 0
                for length, doc, start in pieces:
                    name, ids = kept[doc]
                    rows.append((name, start, length, ids[start : start + length].astype("<u4").tobytes(), len(ids), base + sequence + s, offset, used, base + group + g, doc))
                    offset += length
            sequence += len(full)
            group += max(steps, default=-1) + 1
            fresh = 0
            still = {p[1] for p in waiting}
            for doc in [d for d in kept if d not in still]:
                del kept[doc]
            for i in range(0, len(rows), 2000):
                columns = list(zip(*rows[i : i + 2000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary()), *(pa.array(c, pa.int64()) for c in columns[4:])], names=schema.names)

        for batch in batches:
            kind = batch.column(0).type
            flat, bounds = encoder.encode_all(batch.column(1))
            for name, a, b in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                ids = np.append(flat[a:b].astype(np.uint32), np.uint32(end_id))
                kept[row] = (name, ids)
                waiting.append((len(ids), row, 0))
                fresh += len(ids)
                row += 1
                if fresh >= block_tokens or row - since >= BLOCK_DOCS:
                    yield from flush(False)
                    since = row
        if waiting:
            yield from flush(True)

    return source.mapInArrow(run, schema)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group", "doc_row")
