"""SimHash fingerprints, and near-duplicates through multi-index hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import arrow_bytes, free_name, join_spread, stage, unsigned_hex, with_struct
from .components import min_labels

SHINGLE = 4
SEED = 42
DISTANCE = 4
SMALL_RUN = 64  # table rows of a bucket up to which all its verified pairs are given
STEP = 4096  # rows of a block when a large bucket is searched
ROWS_PER_PART = 500_000  # fingerprints of a shuffle partition
HOT = 16_384  # rows of a bucket beyond which it is dealt out to several tasks
FEW = 100_000  # narrow rows up to which a table is broadcast


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash: a bit is 1 if it is set in over half the hashes of the word shingles."""
    if not text:
        return 0
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        grams = [joined]
    else:
        lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lens)
        starts = (ends - lens)[: len(words) - shingle + 1].tolist()
        ends = (ends[shingle - 1 :] - 1).tolist()
        grams = [joined[a:b] for a, b in zip(starts, ends, strict=True)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64, len(grams))
    set_in = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 200_000):
        set_in += np.unpackbits(hashes[i : i + 200_000, None].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * set_in > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, out: str, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Add long column ``out``: the fingerprint as a signed 64-bit number. No shuffle.

    Defined cases: null, empty and wordless texts give 0; texts shorter than a shingle are one
    shingle; very long texts are read whole; repeated rows give the same; an empty table gives no
    rows; all columns of ``docs`` stay, whatever their names.
    """
    arrow_bytes(docs.sparkSession)
    name = free_name(docs, "simhash_struct")

    def made(columns):
        values = np.array([fingerprint(t, shingle) for t in columns[0].to_pylist()], np.uint64)
        return [pa.array(values.view(np.int64))]

    added = with_struct(docs, name, T.StructType([T.StructField("fp", T.LongType(), False)]), made, [text_col])
    return added.withColumn(out, F.col(f"{name}.fp")).drop(name)


def segments(rows: int, distance: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of each segment: a pair within ``distance`` bits has a segment
    within its radius, because the sum of (radius + 1) exceeds ``distance``.

    Three segments, or two where ``rows`` fingerprints would fill the buckets of three with over
    SMALL_RUN each: from 134 million rows on.
    """
    parts = 3 if rows <= SMALL_RUN << (64 // 3) else 2
    out, at = [], 0
    for k in range(parts):
        bits = (64 - at) // (parts - k)
        out.append((at, bits, (distance + 1 + parts - 1 - k) // parts - 1))
        at += bits
    return out


def _masks(bits: int, radius: int) -> list[int]:
    """The Hamming ball: every way to flip 1 to ``radius`` of ``bits`` bits."""
    return [sum(1 << b for b in flips) for n in range(1, radius + 1) for flips in combinations(range(bits), n)]


def _run_links(values: np.ndarray, probing: np.ndarray, bounds: np.ndarray, distance: int):
    """Verified links of sorted runs; bounds: first row of each run and the end.

    Small runs give every pair (probe, table) within ``distance``. A large run gives the edges of
    a spanning forest over its fingerprints, found by breadth-first search in blocks: as many
    components, and never more edges than rows.
    """
    first, last = bounds[:-1], bounds[1:]
    tables = np.add.reduceat(~probing, first) if len(values) else np.zeros(0, np.int64)
    size = last - first
    small = (tables <= SMALL_RUN) & (size <= 4 * SMALL_RUN)
    # table rows come first in their run, so the partners of a row are a contiguous range
    run_of = np.repeat(np.arange(len(first)), size)
    pick = small[run_of]
    rows = np.flatnonzero(pick)
    partners = tables[run_of[rows]]
    for a in range(0, len(rows), 50_000):
        r, n = rows[a : a + 50_000], partners[a : a + 50_000]
        left = np.repeat(r, n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        right = np.repeat(first[run_of[r]], n) + inner
        x, y = values[left], values[right]
        keep = (x != y) & (np.bitwise_count(x ^ y) <= distance) & (probing[left] | (left > right))
        if keep.any():
            yield x[keep], y[keep]
    for run in np.flatnonzero(~small & (size > 1)):
        left = np.unique(values[first[run] : last[run]])
        links = []
        while len(left):
            frontier, left = left[:1], left[1:]
            while len(frontier) and len(left):
                parent = np.full(len(left), -1, np.int64)
                for f in range(0, len(frontier), STEP):
                    part = frontier[f : f + STEP]
                    for b in range(0, len(left), STEP):
                        near = np.bitwise_count(left[b : b + STEP, None] ^ part[None, :]) <= distance
                        hit = near.any(1)
                        parent[b : b + STEP][hit] = f + near.argmax(1)[hit]
                found = parent >= 0
                if found.any():
                    links.append((frontier[parent[found]], left[found]))
                frontier, left = left[found], left[~found]
        for x, y in links:
            yield x, y


def _sliced(keyed: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows of hot buckets once for every pair of slices (i <= j) that theirs is in."""
    rows = keyed.join(hot, ["k", "v"], "left").withColumn("s", F.coalesce("s", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("s")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda x: F.struct(F.least(own, x).alias("i"), F.greatest(own, x).alias("j")))
    return rows.select("fp", "k", "v", "probe", F.explode(others).alias("p")).select("fp", "k", "v", "probe", "p.i", "p.j")


def near_links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (u, v) whose components are those of all pairs within ``distance`` bits.

    ``prints`` has one row per distinct fingerprint (column fp). Each fingerprint goes into the
    table of every segment, and probes the tables with the small Hamming ball of its segment. A
    flip is probed from the fingerprint that has its highest bit clear only, which finds each pair
    once. Rows meet by (segment, value). Fingerprints are distinct, so copies make no bucket
    large, but near copies can: a bucket of over HOT rows is cut by a hash in s slices, and every
    two slices meet in a task of their own, so no pair is lost and no task gets over 2 HOT rows,
    about.
    """
    fp = F.col("fp")
    rows = []
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = prints.count()
    parts = max(parts, -(-total // ROWS_PER_PART))
    for k, (at, bits, radius) in enumerate(segments(total, distance)):
        value = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << bits) - 1))
        rows.append(F.array(F.struct(F.lit(k).alias("k"), value.alias("v"), F.lit(False).alias("probe"))))
        if radius > 0:
            flips = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(1 << (m.bit_length() - 1)).cast("long").alias("top")) for m in _masks(bits, radius)])
            clear = F.filter(flips, lambda x: value.bitwiseAND(x["top"]) == 0)  # noqa: B023
            rows.append(F.transform(clear, lambda x: F.struct(F.lit(k).alias("k"), value.bitwiseXOR(x["m"]).alias("v"), F.lit(True).alias("probe"))))  # noqa: B023
    # dealt out by count, as the rows are narrow and each becomes many
    keyed = prints.repartition(parts, "fp").select("fp", F.explode(F.concat(*rows)).alias("r")).select("fp", "r.k", "r.v", "r.probe")
    hot = stage(keyed.groupBy("k", "v").count().where(F.col("count") > HOT).select("k", "v", F.ceil(F.col("count") / HOT).cast("int").alias("s")), "hot-buckets")
    few = hot.limit(FEW + 1).count()
    keyed = keyed.withColumn("i", F.lit(0)).withColumn("j", F.lit(0)) if few == 0 else _sliced(keyed, F.broadcast(hot) if few <= FEW else hot)
    keyed = keyed.repartition(parts, "k", "v", "i", "j").sortWithinPartitions("k", "v", "i", "j", "probe")

    def links(frames):
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            # a run may go on in the next batch, so the last one waits
            keys = frame[["k", "v", "i", "j"]].to_numpy()
            edge = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            cut = int(edge[-1]) if len(edge) else 0
            held = frame.iloc[cut:]
            if cut:
                yield from pairs(frame.iloc[:cut], np.append(0, edge))
        if held is not None and len(held):
            yield from pairs(held, np.array([0, len(held)]))

    def pairs(frame, bounds):
        values, probing = frame["fp"].to_numpy().view(np.uint64), frame["probe"].to_numpy()
        for x, y in _run_links(values, probing, bounds, distance):
            yield pd.DataFrame({"u": x.view(np.int64), "v": y.view(np.int64)})

    return keyed.mapInPandas(links, "u long, v long")


def _components(prints: DataFrame, distance: int) -> DataFrame:
    """One row per fingerprint of ``prints`` (doc_id, fp): fp, label, smallest id, copies (n).

    A component's members are spread over all tasks when they fetch its smallest id.
    """
    classes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "classes")
    labels = min_labels(near_links(classes.select("fp"), distance))
    named = stage(classes.join(labels, classes.fp == labels.node, "left").select("fp", "n", "first_id", "label"), "labels")
    alone = named.where("label is null").select("fp", F.col("fp").alias("label"), F.col("first_id").alias("component_id"), "n")
    linked = named.where("label is not null")
    least = linked.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    sizes = least.select("label", F.col("members").alias("n"))
    members = join_spread(linked.select("fp", "n", "label"), least.drop("members"), "label", sizes, linked.count())
    return alone.unionByName(members)


def _with_components(prints: DataFrame, distance: int) -> DataFrame:
    """``prints`` (doc_id, fp and more) with label and component_id; copies may be very many."""
    found = stage(_components(prints, distance), "components")
    total = found.agg(F.sum("n")).first()[0] or 0
    return join_spread(prints, found.drop("n"), "fp", found.select("fp", "n"), total)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fingerprint (long), component_id (smallest id reachable).

    Copies meet first: documents are grouped by fingerprint with a partial minimum of the id, so a
    huge group of copies is one row before any search. Links join fingerprints within
    ``distance`` bits, verified on all 64 bits; components come from alternating star steps.

    Defined cases: null and empty texts have fingerprint 0 and link like any other; null ids take
    no part in the minimum (a component of null ids has a null component_id); repeated rows are
    given each; an empty table gives no rows; other columns are ignored.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    prints = stage(with_fingerprint(source, "fp", "text", shingle).select("doc_id", "fp"), "simhash")
    return _with_components(prints, distance).select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """The documents with one of each near-duplicate group: the smallest (id, text).

    Rows that share an id are judged one by one, each by its own text, so no group loses all its
    texts; equal rows (id and text) count as one. Rows with null ids are kept. The columns and
    their order are those of ``docs``.
    """
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    source = docs.select(ident.alias("doc_id"), text.alias("text"))
    prints = stage(with_fingerprint(source, "fp").select("doc_id", "fp", F.xxhash64("text").alias("row")), "simhash")
    found = stage(_with_components(prints.where("doc_id is not null"), distance).select("doc_id", "row", "label", "component_id"), "found")
    least = found.where("doc_id = component_id")
    # an id with several texts in the component that it leads: all but the first by text go
    shared = least.groupBy("doc_id", "label").agg(F.min("row").alias("a"), F.max("row").alias("b")).where("a <> b").select("doc_id", "label")
    leading = stage(least.join(shared, ["doc_id", "label"]).select("doc_id", "label", "row").distinct(), "shared-ids")
    # few such rows are sent to the texts, so that the texts are not shuffled for them
    leading = F.broadcast(leading) if leading.limit(FEW + 1).count() <= FEW else leading
    texts = source.withColumn("row", F.xxhash64("text")).join(leading, ["doc_id", "row"])
    first = texts.groupBy("doc_id", "label").agg(F.min_by("row", F.struct("text")).alias("first"))
    later = texts.join(first, ["doc_id", "label"]).where("row <> first").select("doc_id", "row")
    gone_id, gone_row = free_name(docs, "gone_id"), free_name(docs, "gone_row")
    gone = found.where("doc_id <> component_id").select("doc_id", "row").unionByName(later).distinct().toDF(gone_id, gone_row)
    kept = docs.join(gone, (ident == F.col(gone_id)) & (F.xxhash64(text) == F.col(gone_row)), "left_anti")
    rank = free_name(docs, "same_row_rank")
    order = Window.partitionBy(ident, F.xxhash64(text)).orderBy(text)
    known = kept.where(ident.isNotNull()).withColumn(rank, F.row_number().over(order)).where(f"{rank} = 1").drop(rank)
    return known.unionByName(kept.where(ident.isNull()))


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", unsigned_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")
