"""Training-order shards of token ids, written as fixed-stride binary files."""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..shared import shared_dir
from .common import arrow_bytes, stage
from .tokens import word_bpe

LENGTH = 2048  # ids of a sequence
END_ID = 1
SHARD_BYTES = 64 << 20
ROUNDS = 6
LEVEL = 6  # of the compression in transit; with a dictionary, the first that profits from it
DICTIONARY_BYTES, DICTIONARY_TEXTS, DICTIONARY_CHARS = 256 << 10, 2000, 4000
KEY = 0x5EED


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Keyed permutation of 0..n-1: a Feistel network on the least even number of bits that holds
    n, walked again from each value that is n or more. The domain is under 4 n, so a walk has
    four steps on average."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = np.asarray(index).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> shift, x & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (_mix(right, key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def dictionary(docs: DataFrame, tokenizer: str, text_col: str) -> bytes:
    """A compression dictionary of at most DICTIONARY_BYTES, from ids of some texts' beginnings.

    It serves only the size of records on their way: what is written does not depend on it.
    """
    some = docs.select(F.substring(F.col(f"`{text_col}`"), 1, DICTIONARY_CHARS).alias("t")).where("t <> ''").limit(DICTIONARY_TEXTS).collect()
    encoder = word_bpe(tokenizer)
    ids = b"".join(encoder.encode(r["t"]).tobytes() for r in some)
    parts = [ids[i : i + 4096] for i in range(0, len(ids), 4096)]
    return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes() if len(parts) >= 256 else b""


def _cut(names: pa.Array, begins: np.ndarray, length: int, records: int, used: int) -> pa.Array:
    """Lists of the pieces (doc_id, start, length) in each of the first ``records`` records.

    Document d lies at begins[d] in the stream, or before 0 for what an earlier record holds;
    the stream has ``used`` ids.
    """
    marks = np.unique(np.concatenate([np.maximum(begins, 0), np.arange(records) * length, [used]]))
    marks = marks[marks <= used]
    at, n = marks[:-1], np.diff(marks)
    doc = np.searchsorted(begins, at, side="right") - 1
    inner = [names.take(pa.array(doc)), pa.array(at - begins[doc]), pa.array(n)]
    fields = [pa.field("doc_id", names.type), pa.field("start", pa.int64()), pa.field("length", pa.int64())]
    return pa.ListArray.from_arrays(np.searchsorted(at, np.arange(records + 1) * length).astype(np.int32), pa.StructArray.from_arrays(inner, fields=fields))


def sequences(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, length: int, end_id: int, known: bytes) -> DataFrame:
    """Token ids of each partition's documents end to end, cut every ``length`` ids; the last is
    padded with the end id. Columns: part, nth, n_tokens, record (compressed), pieces.

    Which documents share a sequence follows from the partitions and the order of ``docs``: another
    layout of the same rows gives other sequences, each whole and each id in one of them.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    piece = T.StructType([T.StructField("doc_id", source.schema[0].dataType), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("nth", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("record", T.BinaryType()), T.StructField("pieces", T.ArrayType(piece))])

    def run(batches):
        encoder, part = word_bpe(tokenizer), TaskContext.get().partitionId()
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(known) if known else None).compress
        stream, names, begins, sizes, nth = np.zeros(0, encoder.dtype), None, np.zeros(0, np.int64), np.zeros(0, np.int64), 0

        def rows(records, last):
            used = [length] * (records - 1) + [last]
            data = [squeeze(stream[i * length : (i + 1) * length].tobytes()) for i in range(records)]
            columns = [pa.array([part] * records, pa.int64()), pa.array(range(nth, nth + records), pa.int64()), pa.array(used, pa.int64()), pa.array(data, pa.binary()), _cut(names, begins, length, records, (records - 1) * length + last)]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            ids, bounds = encoder.encode_all(batch.column(1))
            n = len(bounds) - 1
            with_ends = np.full(len(ids) + n, end_id, encoder.dtype)
            with_ends[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(bounds))] = ids
            names = batch.column(0) if names is None else pa.concat_arrays([names, batch.column(0)])
            begins = np.concatenate([begins, len(stream) + bounds[:-1] + np.arange(n)])
            sizes = np.concatenate([sizes, np.diff(bounds) + 1])
            stream = np.concatenate([stream, with_ends])
            records = len(stream) // length
            if records:
                yield rows(records, length)
                stream, begins, nth = stream[records * length :], begins - records * length, nth + records
                done = int(np.searchsorted(begins + sizes, 0, side="right"))
                names, begins, sizes = names.slice(done), begins[done:], sizes[done:]
        if len(stream):
            last = len(stream)
            stream = np.concatenate([stream, np.full(length - last, end_id, encoder.dtype)])
            yield rows(1, last)

    return source.mapInArrow(run, schema)


def write_shards(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES, key: int = KEY) -> DataFrame:
    """Write all documents as shards of equal records in training order under ``path``.

    Sequences are staged once, compressed. Per-partition counts (a row a partition) give each
    sequence its number i; a keyed Feistel permutation of 0..N-1 gives its slot; slots are cut in
    ranges of equal size, one range a shard; a task sorts its ranges by slot and writes each as one
    file, record after record. File shard-K holds slots K * slots_per_shard and on, so a slot's
    place is known without an index, and a reader can begin or resume at any slot. A file is
    written under a name of its task attempt and renamed when whole, so a lost executor leaves no
    half file and a repeated task gives the same one. ``path`` is a URI that all executors see.

    Returns a row per sequence: slot, shard, byte_offset, n_tokens, record_crc32 (of the bytes as
    written), doc_ids, starts, lengths. Defined cases: a null or empty text is one end id;
    repeated rows are written each; null ids pass through; an empty table writes no shard and
    gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_bytes(spark)
    known = dictionary(docs, tokenizer, text_col)
    staged = stage(sequences(docs, tokenizer, id_col, text_col, length, end_id, known), "sequences", "uncompressed")
    counts = staged.groupBy("part").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    width = word_bpe(tokenizer).dtype.itemsize
    stride = length * width
    per_shard = max(1, shard_bytes // stride)
    shards = max(1, -(-total // per_shard))
    starts = counts.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))

    @F.pandas_udf("long")
    def slot_of(i):
        import pandas as pd

        return pd.Series(permute(i.to_numpy(), total, key))

    placed = staged.join(F.broadcast(starts), "part")  # a row a partition
    placed = placed.withColumn("slot", slot_of(F.col("first") + F.col("nth"))).withColumn("shard", F.expr(f"slot div {per_shard}L"))
    placed = placed.select("shard", "slot", "n_tokens", "record", "pieces")
    ranged = placed.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("slot")
    schema = "slot long, shard long, byte_offset long, n_tokens long, record_crc32 long, pieces " + placed.schema["pieces"].dataType.simpleString()

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(path)
        attempt = TaskContext.get().taskAttemptId()
        expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(known) if known else None).decompress
        fs.create_dir(f"{root}/_attempts", recursive=True)
        now, out = None, None

        def close():
            out.close()
            fs.move(f"{root}/_attempts/{now}-{attempt}", f"{root}/shard-{now:06d}.bin")

        for batch in batches:
            crcs, offsets = [], []
            for shard, slot, record in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if shard != now:
                    if out:
                        close()
                    now, out = shard, fs.open_output_stream(f"{root}/_attempts/{shard}-{attempt}")
                data = expand(record)
                out.write(data)
                crcs.append(zlib.crc32(data))
                offsets.append((slot - shard * per_shard) * stride)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(offsets, pa.int64()), batch.column(2), pa.array(crcs, pa.int64()), batch.column(4)], names=["slot", "shard", "byte_offset", "n_tokens", "record_crc32", "pieces"])
        if out:
            close()

    written = stage(ranged.mapInArrow(write, schema), "placements")
    fs, root = pafs.FileSystem.from_uri(path)
    fs.create_dir(f"{root}/_attempts", recursive=True)
    fs.delete_dir(f"{root}/_attempts")
    about = {"sequences": total, "length": length, "bytes_per_id": width, "stride": stride, "slots_per_shard": per_shard, "shards": shards if total else 0, "key": key}
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(about).encode())
    pieces = lambda name: F.transform("pieces", lambda p: p[name]).alias(name + "s")
    return written.select("slot", "shard", "byte_offset", "n_tokens", "record_crc32", pieces("doc_id"), pieces("start"), pieces("length"))


def read_slots(path: str, first: int, count: int) -> np.ndarray:
    """Sequences of slots first..first+count-1 as an array (count, length), read in order."""
    fs, root = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        about = json.loads(f.read())
    out, slot, last = [], first, min(first + count, about["sequences"])
    while slot < last:
        shard, at = divmod(slot, about["slots_per_shard"])
        n = min(last - slot, about["slots_per_shard"] - at)
        with fs.open_input_file(f"{root}/shard-{shard:06d}.bin") as f:
            out.append(f.read_at(n * about["stride"], at * about["stride"]))
        slot += n
    return np.frombuffer(b"".join(out), f"<u{about['bytes_per_id']}").reshape(-1, about["length"])


def op9_token_output(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    return write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
