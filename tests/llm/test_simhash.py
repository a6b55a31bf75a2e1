from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandline.llm import simhash as sh
from strandline.llm.components import min_labels


def plain(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    rng = random.Random(1)
    texts = [None, "", " \t", "One", "one two", "a b c d", "A\u00a0b c\x0bd e\x1cf", "é É ß " * 9] + [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    assert [sh.fingerprint(t) for t in texts] == [plain(t) for t in texts]


def test_spark_hash_is_the_same(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c d", 42)


def groups(values, links):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


@pytest.mark.parametrize(("clusters", "size", "flips"), [(40, 6, 3), (1, 600, 2), (3, 150, 5)])
@pytest.mark.parametrize("hot", [16_384, 100])
def test_links_lose_no_component(spark, clusters, size, flips, hot, monkeypatch):
    monkeypatch.setattr(sh, "HOT", hot)
    rng = random.Random(size)
    values = set()
    for _ in range(clusters):
        centre = rng.getrandbits(64)
        for _ in range(size):
            v = centre
            for _ in range(rng.randrange(flips + 1)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values |= {rng.getrandbits(64) for _ in range(300)}
    x = np.array(sorted(values), np.uint64)
    a, b = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4)
    signed = x.view(np.int64).tolist()
    true = groups(signed, [(signed[i], signed[j]) for i, j in zip(a, b, strict=True)])
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = [(r["u"], r["v"]) for r in sh.near_links(df).collect()]
    assert all(bin((u ^ v) & (1 << 64) - 1).count("1") <= 4 for u, v in links)
    assert groups(signed, links) == true


def test_segments_cover_four_bits():
    for rows, parts in ((0, 3), (10**8, 3), (10**9, 2), (10**11, 2)):
        for distance in (2, 4, 6):
            made = sh.segments(rows, distance)
            assert len(made) == parts and sum(r + 1 for _, _, r in made) > distance
            assert sorted(b for at, n, _ in made for b in range(at, at + n)) == list(range(64))
            # a bucket has few fingerprints by chance alone
            assert rows / 2 ** min(n for _, n, _ in made) <= 64


def test_two_segments_find_the_same_components(spark, monkeypatch):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = sorted({b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(0, 6))) for b in base for _ in range(4)})
    x = np.array(values, np.uint64)
    a, b = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4)
    signed = x.view(np.int64).tolist()
    monkeypatch.setattr(sh, "segments", lambda rows, distance: [(0, 32, 2), (32, 32, 1)])
    links = [(r["u"], r["v"]) for r in sh.near_links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()]
    assert groups(signed, links) == groups(signed, [(signed[i], signed[j]) for i, j in zip(a, b, strict=True)])


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, i) for i in range(1001, 1200)]
    loose = [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(250)]
    edges = [*chain, *star, *loose, (5, 5), (3, 2), (3, 2)]
    rng.shuffle(edges)
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    got = {r["node"]: r["label"] for r in min_labels(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: g for n, g in groups(sorted(nodes), [e for e in edges if e[0] != e[1]]).items()}
    assert min_labels(spark.createDataFrame([], "u long, v long")).collect() == []


def near_texts():
    rng = random.Random(6)
    docs = []
    for g in range(12):
        ws = [f"w{rng.randrange(5000)}" for _ in range(600)]
        for _ in range(rng.randrange(1, 5)):
            copy = list(ws)
            if rng.random() < 0.7:
                copy[rng.randrange(600)] = "edited"
            docs.append((rng.randrange(10**6) * 12 + g, " ".join(copy)))
    return docs


def test_documents_against_brute_force(spark, odd_rows):
    docs = near_texts() + [(r[0], r[1]) for r in odd_rows]
    prints = [plain(t) for _, t in docs]
    values = sorted(set(prints))
    true = groups(values, [(a, b) for a in values for b in values if (a ^ b).bit_count() <= 4])
    least = {}
    for (i, _), p in zip(docs, prints, strict=True):
        if i is not None:
            least[true[p]] = min(least.get(true[p], i), i)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("fp", F.lit("mine")).withColumn("component_id", F.lit("mine")).repartition(4)
    got = sh.near_duplicates(df).collect()
    expected = [(i, p, least.get(true[p])) for (i, _), p in zip(docs, prints, strict=True)]
    assert sorted(((r["doc_id"], r["fingerprint"] & (1 << 64) - 1, r["component_id"]) for r in got), key=repr) == sorted(expected, key=repr)
    kept = sh.keep_first(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({i for i, _, c in expected if i is not None and i == c})
    assert ids.count(None) == 1


@pytest.mark.parametrize("few", [sh.FEW, 0])
def test_rows_that_share_an_id(spark, few, monkeypatch):
    monkeypatch.setattr(sh, "FEW", few)
    rng = random.Random(8)
    a, b, c, d = (" ".join(f"w{rng.randrange(5000)}" for _ in range(600)) for _ in range(4))
    near = lambda t: t.rsplit(" ", 1)[0] + " edited"
    assert all(0 < (plain(t) ^ plain(near(t))).bit_count() <= 4 or plain(t) == plain(near(t)) for t in (a, c, d))
    rows = [(3, a), (3, c), (5, near(a)), (5, b), (7, near(c)), (9, d), (9, near(d)), (9, d), (None, d)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {tuple(r) for r in sh.keep_first(df).collect()}
    assert kept == {(3, a), (3, c), (5, b), (9, min(d, near(d))), (None, d)}
    assert sh.keep_first(df).count() == len(kept)


def test_empty(none):
    assert sh.near_duplicates(none).collect() == []
    assert sh.keep_first(none).collect() == []
