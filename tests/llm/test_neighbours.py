from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm.hilbert import hilbert_key
from strandline.llm import neighbours
from strandline.llm.neighbours import nearest


def test_hilbert_steps_to_adjacent_cells():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.array(np.meshgrid(*[range(1 << bits)] * d)).reshape(d, -1).T
        key = hilbert_key(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def brute(rows, k=10):
    sound = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    ids, x = np.array([i for i, _ in sound]), np.array([v for _, v in sound], np.float32).astype(float)
    out = {}
    for q in [i for i in ids if i % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), d[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def recall(got, true):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in ns}) for q, ns in true.items()) / sum(map(len, true.values()))


def test_recall_and_order(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + 0.3 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(4000)]
    true, got = brute(rows), found(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert recall(got, true) >= 0.9
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for q, ns in got.items():
        assert len(ns) == 10
        assert ns == sorted(ns, key=lambda n: (n[1], n[0]))
        assert all(abs(np.sqrt(((x[q] - x[i]) ** 2).sum()) - s) < 1e-12 for i, s in ns)


def test_copies_ties_and_unfit_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 900, 3)] + [(i, rng.normal(size=3).astype(np.float32).tolist()) for i in range(1, 900, 3)]
    rows += [(5000, None), (5100, [0.0, 0.0, 0.0]), (5200, [1.0, None, 2.0]), (5300, [1.0, float("nan"), 2.0]), (5400, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (300, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash")).withColumn("key", F.lit("clash"))
    true, got = brute(rows), found(df)
    assert set(got) == set(true)
    for q in true:
        if q % 3 == 0:
            assert [i for i, _ in got[q]] == [i for i, _ in true[q]]
    assert recall(got, true) >= 0.9


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (7, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["rank"]) for r in nearest(df, F.col("vec_id") % 100 == 0).collect()] == [(7, 1)]
    assert nearest(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    assert nearest(df.where("vec_id = 7"), F.col("vec_id") % 100 == 0).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_recall_on_the_test_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert recall(found(df), brute(rows)) >= 0.9


def test_blocks_are_bounded_and_widths_apart(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MOST_BLOCK", 16)
    monkeypatch.setattr(neighbours, "LEAST_WINDOW", 20)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(400)]
    short = [(1000 + i, [float(i), 1.0]) for i in range(0, 300, 50)]
    got = found(spark.createDataFrame(rows + short, "vec_id long, embedding array<float>"))
    assert recall({q: n for q, n in got.items() if q < 1000}, brute(rows)) >= 0.9
    assert {q: got[q] for q in got if q >= 1000} == brute(short)
    monkeypatch.setattr(neighbours, "MOST_WIDTHS", 1)
    with pytest.raises(ValueError, match="lengths"):
        found(spark.createDataFrame(rows + short, "vec_id long, embedding array<float>"))
