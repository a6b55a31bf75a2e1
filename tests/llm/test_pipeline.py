from __future__ import annotations

import os

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from strandline.llm import language, secrets
from strandline.llm.catalogue import QUERIES

from .test_secrets import brute as secret_spans
from .test_simhash import groups, plain
from .test_winnowing import brute as contamination

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "decontaminate", "scrub_secrets", "pack"]

    one = stages["language_id"](spark, docs, SF)
    scored = language.identify(docs, "f").collect()
    assert {r["doc_id"] for r in one.collect()} == {r["doc_id"] for r in scored if r["f"]["lang"] != "und" and r["f"]["score"] >= 0.4}

    two = stages["near_dedup"](spark, one, SF)
    texts = {r["doc_id"]: r["text"] for r in one.collect()}
    prints = {i: plain(t) for i, t in texts.items()}
    values = sorted(set(prints.values()))
    group = groups(values, [(a, b) for a in values for b in values if (a ^ b).bit_count() <= 4])
    first = {}
    for i in sorted(texts):
        first.setdefault(group[prints[i]], i)
    assert {r["doc_id"] for r in two.collect()} == set(first.values())

    three = stages["decontaminate"](spark, two, SF)
    judged = contamination([(r["doc_id"], r["text"]) for r in two.collect()], benchmark)
    assert {r["doc_id"] for r in three.collect()} == {i for i, n, hit, _ in judged if not (hit and 20 * hit >= n)}

    four = stages["scrub_secrets"](spark, three, SF)
    before = {r["doc_id"]: r["text"] for r in three.collect()}
    for r in four.collect():
        out, at = [], 0
        for a, _, b in secret_spans(before[r["doc_id"]]):
            if a >= at:
                out += [before[r["doc_id"]][at:a], "[SECRET]"]
            at = max(at, b)
        assert r["text"] == "".join(out) + before[r["doc_id"]][at:]
    assert all(d.columns == docs.columns for d in (one, two, three, four))

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {}
    for r in stages["pack"](spark, four, SF).orderBy("start").collect():
        got.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert got == {r["doc_id"]: whole.encode(r["text"], add_special_tokens=False).ids + [1] for r in four.collect()}
    assert secrets.KINDS[0] == "assign"


def test_run_is_the_stages(spark):
    assert QUERIES["pipeline"](spark, SF).count() > 100


def test_odd_input_through_all_stages(spark, odd, none):
    """Nulls, empty and long texts, repeated rows, extra columns with clashing names, empty tables."""
    names = ["secrets", "contamination", "language", "fp", "tokens"]
    docs = odd.selectExpr("*", *[f"'mine' as {n}" for n in names])
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(step(spark, docs, SF).collect(), docs.schema)
        rows = docs.collect()
        assert rows and all(r[n] == "mine" for r in rows for n in names)
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()} == {r["doc_id"] for r in docs.collect()}
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, none, SF).collect() == []


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 11))
