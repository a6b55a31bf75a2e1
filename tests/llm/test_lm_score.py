from __future__ import annotations

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import lm_score as lm

from .test_winnowing import words


def brute(docs, backoff=0.4, order=3):
    ws = [words(t) for _, t in docs]
    grams = lambda w, n: Counter(zip(*(w[i:] for i in range(n)), strict=False))
    counts = {n: sum((grams(w, n) for w in ws), Counter()) for n in range(1, order + 1)}
    total, out = sum(map(len, ws)), []
    for (i, _), w in zip(docs, ws, strict=True):
        own, rest = {n: grams(w, n) for n in counts}, total - len(w)
        c = lambda g: counts[len(g)][g] - own[len(g)][g]

        def score(g):
            if len(g) == 1:
                return math.log(c(g) / rest) if c(g) else math.log(1 / (rest + 1))
            return math.log(c(g) / c(g[:-1])) if c(g) else math.log(backoff) + score(g[1:])

        s = sum(score(tuple(w[max(0, k - order + 1) : k + 1])) for k in range(len(w)))
        out.append((i, len(w), s))
    return sorted(out, key=repr)


def check(df, docs, **how):
    got = sorted(((r["doc_id"], r["n_words"], r["log_score"], r["mean_log_score"]) for r in lm.lm_scores(df, **how).collect()), key=repr)
    for (i, n, s, mean), (j, m, t) in zip(got, sorted(brute(docs), key=lambda r: repr((r[0], r[1], r[2]))), strict=True):
        assert (i, n) == (j, m)
        assert s == pytest.approx(t, rel=1e-9, abs=1e-9)
        assert mean == (pytest.approx(t / n) if n else None)


@pytest.mark.parametrize("how", [{}, {"block_bytes": 30_000, "fan_bits": 2, "gather": (3, 2)}])
def test_against_brute_force(spark, odd_rows, how):
    rng = random.Random(1)
    docs = [(100 + i, " ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(0, 80)))) for i in range(200)] + [(r[0], r[1]) for r in odd_rows]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit("mine")).withColumn("block", F.lit("mine")).repartition(5)
    check(df, docs, **how)


def test_one_document_and_none(spark, none):
    check(spark.createDataFrame([(1, "a b a b")], "doc_id long, text string"), [(1, "a b a b")])
    assert lm.lm_scores(none).collect() == []


def test_round_trip_of_planes():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (lm.unpack_sorted(lm.pack_sorted(keys)) == keys).all()
    assert len(lm.unpack_sorted(lm.pack_sorted(keys[:0]))) == 0
    numbers = rng.integers(0, 1 << 32, 500)
    assert (lm.unpack_numbers(lm.pack_numbers(numbers)) == numbers).all()
    assert lm.unpack_numbers(lm.pack_numbers(np.array([1 << 40, 0, 3]))).tolist() == [1 << 40, 0, 3]


def test_rows_stay_in_proportion(spark):
    """A block gives 2 ** bits rows a level at most, however many blocks there are."""
    rng = random.Random(2)
    rows = lambda n: [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(120))) for i in range(n)]

    def pieces(n):
        df = spark.createDataFrame(rows(n), "doc_id long, text string").coalesce(1)
        blocks = lm._blocks(df, 4000)
        return blocks.count(), lm.exploded(blocks, 3, 4).count()

    (b1, r1), (b2, r2) = pieces(60), pieces(600)
    assert r1 <= 16 * b1 and r2 <= 16 * b2 and b2 >= 8 * b1


def test_scoring_a_block_takes_a_bounded_share_of_memory():
    """Bytes for each word of a block beside the input; arrays of all orders at once took 238."""
    rng = np.random.default_rng(3)
    words = (rng.zipf(1.3, 400_000) % 50_000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sizes = np.full(1000, 400)
    total = np.full(sum(len(np.unique(lm._ngrams(words, sizes, n)[0])) for n in (1, 2, 3)), 1000)
    tracemalloc.start()
    try:
        lm.block_scores(words, sizes, total, 10**6, 3, 0.4)
        assert tracemalloc.get_traced_memory()[1] / len(words) < 190
    finally:
        tracemalloc.stop()


def test_ngrams_are_made_in_one_worker_a_task(spark, odd):
    """Every Python step of a stage is a worker beside the others, and stays when the task ends."""
    plan = lm.exploded(lm._blocks(odd.select("doc_id", "text"), 4000), 3, 4)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"MapIn(?:Arrow|Pandas)", plan)) == 1
