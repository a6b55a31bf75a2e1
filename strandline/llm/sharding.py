"""Contiguous shards of nearly equal byte size, from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage

ROWS_PER_PART = 2_000_000  # rows of a range partition; they are about 40 bytes each


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every row in one of ``shards`` contiguous shards of nearly equal bytes.

    Rows are range-partitioned by (hash of the text, id), which keeps equal texts together and
    still splits a huge group of copies, as the id is part of the range. The narrow rows (id,
    size, hash) are staged with their partition number; per-partition totals give each
    partition's first byte; a running sum inside the partition gives each row's first byte, and
    that over ``total / shards`` is its shard. A group of equal texts takes the shard of its
    first byte, also where it lies across partitions, unless it is larger than both the largest
    single text and a hundredth of a shard: such a group is cut at the targets, so that sizes
    stay near equal. So a cut moves by less than one document or a hundredth of a shard.

    Returns doc_id, size (UTF-8 bytes + 1), text_crc32, shard, slot (position in the shard, from
    0), global_slot, start_byte. Defined cases: a null text has no bytes (size 1, crc 0); null ids
    sort first; repeated rows each get a slot; an empty table gives no rows; other columns are
    ignored.
    """
    text = F.col(f"`{text_col}`")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // ROWS_PER_PART))
    rows = stage(rows.repartitionByRange(parts, "h", "doc_id").withColumn("pid", F.spark_partition_id()), "shard-rows")

    everything = Window.partitionBy()
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition, so these windows and the broadcast are bounded by `parts`
    totals = rows.groupBy("pid").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.max("size").alias("most"), F.min("h").alias("low"), F.max("h").alias("high"))
    starts = totals.select(
        "pid",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("first_byte"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_row"),
        F.sum("bytes").over(everything).alias("total"),
        F.max("most").over(everything).alias("largest"),
    )
    run = Window.partitionBy("pid").orderBy("h", "doc_id", "size", "text_crc32")
    group = Window.partitionBy("pid", "h")
    placed = rows.join(F.broadcast(starts), "pid").withColumns(
        {
            "start_byte": F.col("first_byte") + F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"),
            "global_slot": F.col("first_row") + F.row_number().over(run) - 1,
        }
    )
    # groups across an edge: at most one for each two neighbours, so these tables are bounded too
    ends = totals.select("pid", F.explode(F.array_distinct(F.array("low", "high"))).alias("h"))
    across = ends.groupBy("h").count().where("count > 1").select("h")
    shares = rows.join(F.broadcast(across), "h").groupBy("h", "pid").agg(F.sum("size").alias("share"))
    shares = shares.join(F.broadcast(starts), "pid").join(F.broadcast(totals.select("pid", "bytes")), "pid")
    # the first partition of such a group ends with it
    edges = shares.groupBy("h").agg(F.sum("share").alias("edge_bytes"), F.min_by(F.col("first_byte") + F.col("bytes") - F.col("share"), "pid").alias("edge_start"))
    placed = placed.join(F.broadcast(edges), "h", "left")
    whole = F.coalesce("edge_bytes", F.sum("size").over(group)) <= F.greatest(F.col("largest"), F.expr(f"total div {100 * shards}L"))
    anchor = F.when(whole, F.coalesce("edge_start", F.min("start_byte").over(group))).otherwise(F.col("start_byte"))
    placed = placed.withColumn("anchor", anchor).withColumn("shard", F.expr(f"int((anchor * {shards}L) div total)"))
    # at most parts + shards rows; the first global position of each shard
    firsts = placed.groupBy("pid", "shard").agg(F.min("global_slot").alias("first")).groupBy("shard").agg(F.min("first").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("global_slot") - F.col("first")).cast("long").alias("slot"), F.col("global_slot").cast("long").alias("global_slot"), "start_byte"
    )


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "global_slot", "start_byte")
