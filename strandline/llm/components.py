"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage

MAX_ROUNDS = 60


def min_labels(edges: DataFrame, rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v): label is the smallest node reachable.

    Each step groups neighbours by node with a partial minimum and joins it back, so no group is
    gathered in one task, and a node with very many neighbours is split by AQE's skew join. Each
    round's edges are a staged table. Only the number of changed edges reaches the driver. The
    number of rounds grows with the logarithm of a component's size; an unfinished result raises.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stage(edges, "edges")
    before = None
    for _ in range(rounds):
        # large star: every larger neighbour of u goes to the least of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges, old = stage(small, "edges"), edges
        discard(old)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        before = now
    raise RuntimeError(f"components need more than {rounds} rounds")
