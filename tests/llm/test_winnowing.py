from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import winnowing as w
from strandline.llm.common import utf8

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, span=13):
    windows = {}
    for i, t in items:
        ws = words(t)
        n = min(span, len(ws))
        for k in range(len(ws) - n + 1 if n else 0):
            windows.setdefault(tuple(ws[k : k + n]), set()).add(i)
    out = []
    for d, t in docs:
        ws, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(ws) - n + 1):
                if tuple(ws[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(ws[k : k + n])]
        out.append((d, len(ws), len(hit), sorted(map(str, found))))
    return sorted(out, key=repr)


def ours(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("found", F.lit("mine")).withColumn("n_words", F.lit(-1))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    marked = w.mark_contamination(d.repartition(3), b, "Found_x", **options)
    n_words, n_hit, _ = w.counts(marked, "Found_x")
    rows = marked.select("doc_id", n_words.alias("n"), n_hit.alias("h"), F.col("Found_x")["items"].alias("i")).collect()
    return sorted(((r["doc_id"], r["n"], r["h"], sorted(str(x) for x in r["i"])) for r in rows), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    vocabulary = ["the", "The", "cat", "dög", "9", "a1", "中文", "x"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", "_"]) for _ in range(n))
    items = [(i, text(rng.choice([13, 14, 20, 40]))) for i in range(25)] + [(30, "short one"), (31, "The, CAT the"), (32, None), (33, ""), (34, "..."), (35, "a " * 40), (None, text(15))]
    items += [(40, items[0][1]), (41, items[0][1]), (30, "short one")]
    docs = []
    for d in range(150):
        parts = [text(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            source = rng.choice(items)[1] or ""
            ws = words(source)
            a = rng.randrange(0, max(1, len(ws) - 11))
            parts += [" ".join(ws[a : a + rng.choice([12, 13, 14, 30])]).upper(), text(rng.randrange(0, 30))]
        docs.append((d, " ".join(parts)))
    docs += [(900, None), (901, ""), (902, "?!"), (903, "a " * 5000), (None, items[1][1]), (904, items[2][1]), (904, items[2][1])]
    return docs, items


def test_against_brute_force(spark, corpus):
    docs, items = corpus
    assert ours(spark, docs, items) == brute(docs, items)


def test_benchmark_in_blocks(spark, corpus):
    docs, items = corpus
    assert ours(spark, docs, items, block_bytes=700) == brute(docs, items)


def test_small_slices(spark, corpus, monkeypatch):
    docs, items = corpus
    index = w.Index([i for i in items if i[1] is not None], 13, 5)
    data = b"".join((t or "").encode() for _, t in docs)
    offsets = np.cumsum([0] + [len((t or "").encode()) for _, t in docs])
    n, hits, _ = w.scan(index, np.frombuffer(data, np.uint8), offsets)
    expected = {i: r for i, r in enumerate(docs)}
    assert n.tolist() == [len(words(expected[i][1])) for i in range(len(docs))]
    assert all(b <= n[d] for d, spans in hits.items() for _, b in spans)


def test_every_shared_window_shares_a_fingerprint():
    rng = np.random.default_rng(3)
    for _ in range(200):
        shared = rng.integers(0, 5, 13).astype(np.uint64)
        sides = [w._mix(np.concatenate([rng.integers(0, 5, rng.integers(0, 20)).astype(np.uint64), shared, rng.integers(0, 5, rng.integers(0, 20)).astype(np.uint64)])) for _ in range(2)]
        prints = []
        for s in sides:
            grams = w.gram_hashes(s, 5)
            prints.append(set(grams[w.winnow(grams, np.array([0]), np.array([len(s)]), 5, 9)].tolist()))
        assert prints[0] & prints[1]


def test_rule_and_empty_tables(spark, none):
    item = " ".join(f"b{i}" for i in range(13))
    docs = spark.createDataFrame([(1, item + " " + " ".join(f"c{i}" for i in range(247))), (2, item + " " + " ".join(f"c{i}" for i in range(248))), (3, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in w.decontaminate(docs, bench).collect()) == [2, 3]
    assert w.decontaminate(docs, bench).columns == docs.columns
    assert w.decontaminate(docs, bench.limit(0)).count() == 3
    assert w.decontaminate(none, bench).collect() == []


def test_a_benchmark_of_20_megabytes():
    """The index stays under eight times its text and finds what is planted."""
    rng = np.random.default_rng(6)
    vocabulary = ["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(3, 11, 40_000)]
    draws = rng.integers(0, len(vocabulary), (1500, 1800))
    items = [(i, " ".join([vocabulary[j] for j in row])) for i, row in enumerate(draws)]
    size = sum(len(t) for _, t in items)
    index = w.Index(items, 13, 5)
    assert size > 20e6 and index.nbytes() < 8 * size
    planted = [(i, rng.integers(0, 1700)) for i in range(0, 1500, 100)]
    texts = ["x y z " + " ".join(items[i][1].split()[k : k + 20]) + " q" for i, k in planted] + ["nothing here " * 30]
    raw, offsets = utf8(pa.array(texts))
    n_words, intervals, found = w.scan(index, raw, offsets)
    assert [found.get(d, set()) for d in range(len(texts))] == [{i} for i, _ in planted] + [set()]
    assert all(w.merged(intervals[d]) == [(3, 23)] for d in range(len(planted)))
