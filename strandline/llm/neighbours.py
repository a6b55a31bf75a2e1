"""Approximate nearest neighbours on shifted Hilbert curves."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage
from .hilbert import hilbert_key

CURVES, DIMS, BITS = 16, 10, 6
NEAREST = 10
SAMPLE = 4096  # vectors that scale the projections
TUNING = 96  # queries answered by brute force to fit the window
TARGET = 0.95  # share of true neighbours that the window must reach on them
LEAST_WINDOW = 64
MOST_BLOCK = 4096  # classes of a block of ranks
MOST_WIDTHS = 16


@dataclass
class Curves:
    """Random projections, each scaled to a grid and shifted."""

    projections: np.ndarray  # (curves, width, dims)
    centre: np.ndarray  # (curves, dims)
    scale: np.ndarray
    shift: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, seed: int = 5) -> Curves:
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        dims = min(DIMS, width)
        p = np.stack([np.linalg.qr(rng.normal(size=(width, width)))[0][:, :dims] for _ in range(CURVES)])
        y = np.einsum("nw,cwd->cnd", sample, p)
        spread = y.std(axis=1)
        return Curves(p, y.mean(axis=1), np.where(spread > 0, spread, 1.0), rng.uniform(-0.1, 0.1, (CURVES, dims)))

    def key(self, c: int, x: np.ndarray) -> np.ndarray:
        y = (x @ self.projections[c] - self.centre[c]) / self.scale[c]
        cells = np.clip(((y + 4) / 8 + self.shift[c]) * (1 << BITS), 0, (1 << BITS) - 1)
        return hilbert_key(cells.astype(np.int64), BITS)


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _sound(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _nearest(points: np.ndarray, names: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest (name, distance), nearest first, ties to the smaller name."""
    gap = points - query
    d = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    if len(d) > 4 * k:
        near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
        names, d = names[near], d[near]
    order = np.lexsort((names, d))[:k]
    return names[order], d[order]


def _brute(classes: DataFrame, sample: list, k: int) -> dict[int, list[int]]:
    """True neighbours of the sample queries among all classes: one pass, k rows a batch and query."""
    reps = np.array([r["rep"] for r in sample])
    vectors = np.array([r["vec"] for r in sample], np.float64)

    def search(frames):
        for f in frames:
            points, names = _stack(f["vec"]), f["rep"].to_numpy()
            for q, v in zip(reps, vectors, strict=True):
                n, d = _nearest(points, names, v, k + 1)
                yield pd.DataFrame({"q": np.full(len(n), q), "p": n, "d": d})

    found = classes.select("rep", "vec").mapInPandas(search, "q long, p long, d double").where("q <> p")
    order = Window.partitionBy("q").orderBy("d", "p")
    out: dict[int, list[int]] = {}
    for r in found.withColumn("n", F.row_number().over(order)).where(f"n <= {k}").collect():
        out.setdefault(r["q"], []).append(r["p"])
    return out


def _window(ranked: DataFrame, truth: dict[int, list[int]]) -> tuple[int, int]:
    """(curves, window): of the first 4, 8 or all curves with the least distance in rank that
    reaches TARGET of the true neighbours on some curve, the pair with the fewest candidates."""
    reps = sorted({*truth, *(p for ps in truth.values() for p in ps)})
    if not reps:
        return CURVES, LEAST_WINDOW
    spark = ranked.sparkSession
    wanted = spark.createDataFrame([(r,) for r in reps], "rep long")  # at most TUNING * 11 rows
    place: dict[int, dict[int, int]] = {}
    for r in ranked.join(F.broadcast(wanted), "rep").select("rep", "curve", "rank").collect():
        place.setdefault(r["rep"], {})[r["curve"]] = r["rank"]
    apart = np.array([[abs(place[q][c] - place[p][c]) for c in range(CURVES)] for q, ps in truth.items() for p in ps])
    if not len(apart):
        return CURVES, LEAST_WINDOW
    fits = [(n, max(LEAST_WINDOW, int(np.quantile(apart[:, :n].min(axis=1), TARGET, method="higher")))) for n in (CURVES // 4, CURVES // 2, CURVES)]
    return min(fits, key=lambda f: (f[0] * f[1], f[0]))


def nearest(vectors: DataFrame, is_query: Column, k: int = NEAREST, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest rows found for each query row: query_id, rank, vec_id, score (Euclidean).

    Equal vectors are one class, which holds its k + 1 smallest ids (a partial top-k before the
    shuffle, so a vector that a third of the rows share is no large group). Each class gets a key
    on CURVES Hilbert curves of random projections with random shifts; Spark range-partitions by
    (curve, key), and per-partition counts give ranks. A query meets the classes of the blocks of
    ranks around its own, at least ``window`` ranks to either side; per block the nearest are found
    with exact distances, and curves are merged and ranked again. A block holds at most MOST_BLOCK
    classes, and only blocks that a query asks for get their vectors.

    Curves and window are fitted: TUNING queries are answered by brute force over all rows, and of
    the pairs that reach TARGET of their true neighbours the one with fewest candidates is taken.
    Every row is indexed.

    Defined cases: vectors that are null, zero, or hold null or non-finite components take no
    part, nor do null ids; vectors of another length have no distance to a query, so each length
    is searched by itself (more than MOST_WIDTHS lengths raise ValueError); of rows that share an
    id and vector one counts; fewer than k candidates are all given; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.where(is_query.isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("vec"), is_query.alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & _sound(F.col("vec")))
    widths = [r["w"] for r in rows.groupBy(F.size("vec").alias("w")).count().orderBy("w").limit(MOST_WIDTHS + 1).collect()]
    if len(widths) > MOST_WIDTHS:
        raise ValueError(f"vectors of more than {MOST_WIDTHS} lengths")
    found = [_nearest_of_width(rows.where(F.size("vec") == w), k) for w in widths]
    return reduce(DataFrame.unionByName, found, spark.createDataFrame([], "query_id long, rank int, vec_id long, score double"))


def _nearest_of_width(rows: DataFrame, k: int) -> DataFrame:
    """`nearest` for sound vectors (id, vec, asks) of one length."""
    spark = rows.sparkSession
    rows = rows.withColumn("h", F.xxhash64("vec"))
    first = Window.partitionBy("h", "vec").orderBy("id")
    members = rows.select("h", "vec", "id").withColumn("n", F.row_number().over(first)).where(f"n <= {k + 1}")
    members = members.groupBy("h", "vec").agg(F.array_sort(F.array_distinct(F.collect_list("id"))).alias("members"))
    asking = rows.where("asks").select("h", "vec", F.col("id").alias("query_id")).distinct()
    classes = members.join(asking.select("h", "vec").distinct().withColumn("asks", F.lit(True)), ["h", "vec"], "left")
    classes = stage(classes.select(F.get("members", F.lit(0)).alias("rep"), "h", "vec", "members", F.coalesce("asks", F.lit(False)).alias("asks")), "vectors")
    sample = classes.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("vec").collect()
    curves = Curves.fit(np.array([r["vec"] for r in sample], np.float64))

    def keyed(frames):
        for f in frames:
            x, n = _stack(f["vec"]), len(f)
            for c in range(CURVES):
                yield pd.DataFrame({"curve": np.full(n, c, np.int32), "key": curves.key(c, x), "rep": f["rep"].to_numpy(), "asks": f["asks"].to_numpy()})

    keys = classes.select("rep", "asks", "vec").mapInPandas(keyed, "curve int, key long, rep long, asks boolean")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = stage(keys.repartitionByRange(parts, "curve", "key", "rep").withColumn("pid", F.spark_partition_id()), "curves")
    starts = keys.groupBy("pid").count().select("pid", F.coalesce(F.sum("count").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    run = Window.partitionBy("pid").orderBy("curve", "key", "rep")
    ranked = keys.join(F.broadcast(starts), "pid").select("curve", "rep", "asks", (F.col("start") + F.row_number().over(run)).alias("rank"))  # starts: a row a partition
    tuning = classes.where("asks").orderBy(F.xxhash64("rep", F.lit(1))).limit(TUNING).select("rep", "vec").collect()
    curves_used, window = _window(ranked, _brute(classes, tuning, k)) if tuning else (CURVES, LEAST_WINDOW)
    size = min(window, MOST_BLOCK)
    reach = -(-window // size)

    placed = ranked.where(F.col("curve") < curves_used).withColumn("block", F.expr(f"rank div {size}L"))
    vectors = classes.select("rep", "vec")
    around = F.explode(F.sequence(F.col("block") - reach, F.col("block") + reach)).alias("block")
    asked = placed.where("asks").select("curve", "rep", around)
    wanted = asked.select("curve", "block").distinct()
    points = placed.select("curve", "block", "rep").join(wanted, ["curve", "block"], "left_semi").join(vectors, "rep")
    fresh = [F.col(c).alias(c) for c in ("curve", "block", "rep")]  # aliased, as both sides come from one table
    asks = asked.select(*fresh).join(vectors.select(*[F.col(c).alias(c) for c in ("rep", "vec")]), "rep")

    def meet(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({"q": [], "p": [], "d": []}).astype({"q": "int64", "p": "int64", "d": "float64"})
        x, names = _stack(p["vec"]), p["rep"].to_numpy()
        out = [_nearest(x, names, v, k + 1) for v in _stack(q["vec"])]
        return pd.DataFrame({"q": np.repeat(q["rep"].to_numpy(), [len(n) for n, _ in out]), "p": np.concatenate([n for n, _ in out]), "d": np.concatenate([d for _, d in out])})

    found = points.groupBy("curve", "block").cogroup(asks.groupBy("curve", "block")).applyInPandas(meet, "q long, p long, d double")
    best = Window.partitionBy("q").orderBy("d", "p")
    found = found.groupBy("q", "p").agg(F.min("d").alias("d")).withColumn("n", F.row_number().over(best)).where(f"n <= {k + 1}")
    # classes to rows: k + 1 for each asking class, then each query's own without itself
    spread = found.join(classes.select(F.col("rep").alias("p"), "members"), "p").select("q", "d", F.explode("members").alias("vec_id"))
    spread = spread.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("d", "vec_id"))).where(f"n <= {k + 1}")
    owners = asking.join(classes.select("h", "vec", F.col("rep").alias("q")), ["h", "vec"]).select("query_id", "q")
    out = owners.join(spread, "q").where("vec_id <> query_id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))).where(f"rank <= {k}")
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("d").alias("score"))


def op4_nearest(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 100 == 0)
