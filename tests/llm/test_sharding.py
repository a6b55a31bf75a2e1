from __future__ import annotations

import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from strandline.llm.sharding import shard_by_bytes


def check(rows, docs, shards):
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs), key=repr)
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r["shard"] < shards
        by[r["shard"]].append(r)
    for rs in by.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
    assert sorted(r["global_slot"] for r in rows) == list(range(len(rows)))
    # contiguous: shards follow one another in the global order
    assert [r["shard"] for r in sorted(rows, key=lambda r: r["global_slot"])] == sorted(r["shard"] for r in rows)
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for k in range(shards):
        assert abs(sum(r["size"] for r in by[k]) - total / shards) <= 3 * largest


def test_law(spark):
    rng = random.Random(1)
    docs = [(i, "x" * rng.randrange(0, 300) + str(i)) for i in range(3000)] + [(5000 + i, "copy " * 20) for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("size", F.lit("clash"))
    check(shard_by_bytes(df, 16).collect(), docs, 16)


def test_small_groups_stay_together(spark):
    docs = [(i, f"text {i % 500} " + "y" * 40) for i in range(1500)] + [(9999, "z" * 5000)]
    where = defaultdict(set)
    for r in shard_by_bytes(spark.createDataFrame(docs, "doc_id long, text string"), 8).collect():
        where[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def placement(docs, shards):
    """The law, plainly: texts in the order of their hashes, groups whole where they fit."""
    total, largest = sum(size for _, size, _ in docs), max(size for _, size, _ in docs)
    at, out = 0, {}
    groups = defaultdict(list)
    for d in docs:
        groups[d[2]].append(d)
    for h in sorted(groups):
        size, start = sum(d[1] for d in groups[h]), at
        for i, n, _ in sorted(groups[h]):
            out[i] = (start if size <= max(largest, total // (100 * shards)) else at) * shards // total
            at += n
    return out


def test_placement_against_brute_force(spark):
    rng = random.Random(5)
    docs = [(i, "z" * rng.randrange(0, 400)) for i in range(900)] + [(1000 + i, "copy " * 9) for i in range(800)] + [(3000 + i, f"few {i % 7}" * 5) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    hashed = [(r["doc_id"], len(r["text"]) + 1, r["h"]) for r in df.withColumn("h", F.xxhash64("text")).collect()]
    for shards in (1, 5, 16):
        assert {r["doc_id"]: r["shard"] for r in shard_by_bytes(df, shards).collect()} == placement(hashed, shards)


def test_a_group_over_many_partitions(spark):
    """Eight copies of a long text and little else: range partitions cut the group, shards do not."""
    docs = [(i, "copy " * 100) for i in range(8)] + [(100 + i, f"t{i}" * 700) for i in range(6)]
    rows = shard_by_bytes(spark.createDataFrame(docs, "doc_id long, text string"), 3).collect()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    assert {r["doc_id"]: r["shard"] for r in rows} == placement([(r["doc_id"], len(r["text"]) + 1, r["h"]) for r in df.collect()], 3)


def test_odd(odd, odd_rows):
    check(shard_by_bytes(odd, 3).collect(), [(r[0], r[1]) for r in odd_rows], 3)


def test_empty(none):
    assert shard_by_bytes(none).collect() == []
