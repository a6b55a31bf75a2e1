"""What the training-data operators share: staged tables, Arrow text buffers, added columns."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sizes import arrow_bytes as arrow_bytes
from ..shared import shared_dir


def stage(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and
    values that depend on the evaluation (partition numbers, random order) are fixed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._staged_path = path
    spark.__dict__.setdefault("_staged_paths", set()).add(path)
    return made


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    spark.__dict__.get("_staged_paths", set()).discard(path)


def discard(staged: DataFrame) -> None:
    """Delete a staged table that nothing reads any more, such as an earlier round's."""
    _delete(staged.sparkSession, staged._staged_path)


def discard_all(spark: SparkSession) -> None:
    """Delete every table this session has staged; call it when the results are written."""
    for path in list(spark.__dict__.get("_staged_paths", ())):
        _delete(spark, path)


def join_spread(many: DataFrame, one: DataFrame, key: str, counts: DataFrame, total: int) -> DataFrame:
    """Inner join on ``key`` of many rows with a table of one row a key, whatever keys are frequent.

    ``counts`` (key, n) says how often a key is among the ``total`` rows of ``many``. Keys with over
    a thousandth of the rows, fewer than a thousand, are broadcast and meet their rows where those
    are; so no shuffle partition gets more than a thousandth of the rows from one key.
    """
    hot = free_name(many, "is_hot_key")
    frequent = stage(counts.where(F.col("n") * 1000 > total).select(key, F.lit(True).alias(hot)), "hot-keys")
    marked = many.join(F.broadcast(frequent), key, "left")
    few = one.join(F.broadcast(frequent.select(key)), key, "left_semi")
    here = marked.where(F.col(hot)).drop(hot).join(F.broadcast(few), key)
    return here.unionByName(marked.where(F.col(hot).isNull()).drop(hot).join(one, key))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores appended while the frame has such a column in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its n + 1 offsets, from 0; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    n = len(array)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(offsets, kind)[array.offset : array.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of marked bytes that end with their text: starts, ends, first run of each text (n + 1)."""
    edge = np.zeros(len(mask) + 1, bool)
    edge[:-1] = mask
    edge[1:-1] &= ~mask[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(mask))]
    edge[inner] |= mask[inner]  # a run does not go on into the next text
    starts = np.flatnonzero(edge)
    stop = np.zeros(len(mask) + 1, bool)
    stop[1:] = mask
    stop[1:-1] &= ~mask[1:]
    stop[inner] |= mask[inner - 1]
    return starts, np.flatnonzero(stop), np.searchsorted(starts, offsets)


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Cut rows into runs of about ``most`` bytes: (first row, row after the last)."""
    out, first, n = [], 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        out.append((first, last))
        first = last
    return out


def with_struct(df: DataFrame, name: str, fields: T.StructType, fn, columns: list[str]) -> DataFrame:
    """Add struct column ``name``, which ``fn`` computes batch by batch without a shuffle.

    ``fn`` gets a list of Arrow arrays (``columns``) and returns one Arrow array per field.
    All other columns pass through, whatever their names are.
    """
    places = [df.columns.index(c) for c in columns]
    kind = pa.struct(_arrow_fields(fields))
    schema = T.StructType([*df.schema.fields, T.StructField(name, fields, False)])

    def run(batches):
        for batch in batches:
            made = fn([batch.column(i) for i in places])
            made = [a if isinstance(a, pa.Array) and a.type == f.type else pa.array(a, f.type) for a, f in zip(made, kind, strict=True)]
            struct = pa.StructArray.from_arrays(made, fields=list(kind))
            names = [*batch.schema.names, name]
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=names)

    return df.mapInArrow(run, schema)


def _arrow_fields(fields: T.StructType) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [pa.field(f.name, to_arrow_type(f.dataType), f.nullable) for f in fields.fields]


def unsigned_hex(c: Column) -> Column:
    """16 lowercase hex digits of a long."""
    return F.lpad(F.lower(F.hex(c)), 16, "0")
