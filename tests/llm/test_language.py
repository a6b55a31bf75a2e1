from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import language

SYLLABLES = {"aa": ["tion", "the", "ing", "wh"], "bb": ["ción", "que", "rr", "ll"], "cc": ["keit", "sch", "ü", "zu"]}


def docs(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 120)))
        out.append((i, text, lang, "s", len(text)))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(docs(600), "doc_id long, text string, lang string, source string, n_chars long")


def test_held_out_accuracy(rows):
    found = language.identify(rows, "found")
    held = found.where(~language.learned_rows(found, "doc_id")).collect()
    assert len(held) > 80
    assert all(0 <= r["found"]["score"] <= 1 for r in held)
    assert sum(r["found"]["lang"] == r["lang"] for r in held) / len(held) > 0.97


def test_held_out_rows_are_not_learned_from(rows):
    flipped = rows.withColumn("lang", F.when(language.learned_rows(rows, "doc_id"), F.col("lang")).otherwise("zz"))
    assert {lang for lang, _ in language.samples_of(flipped, "doc_id", "text", "lang")} == set(SYLLABLES)
    assert language.samples_of(flipped, "doc_id", "text", "lang") == language.samples_of(rows, "doc_id", "text", "lang")
    ids = [r["doc_id"] for r in rows.where(~language.learned_rows(rows, "doc_id")).collect()]
    assert ids and all(zlib.crc32(str(i).encode()) % 4 == 2 for i in ids)


def test_sample_is_bounded(rows):
    got = language.samples_of(rows, "doc_id", "text", "lang", per_language=10)
    assert all(sum(lang == k for lang, _ in got) <= 10 * language.WINDOWS_PER_DOC for k in SYLLABLES)


def test_odd_rows_and_clashes(spark, rows, odd):
    model = language.train(language.samples_of(rows, "doc_id", "text", "lang"))
    clash = odd.withColumn("found", F.lit("mine")).withColumn("score", F.lit(1))
    got = language.with_language(clash, "Found_", model).collect()
    assert len(got) == 10
    for r in got:
        lettered = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert (r["Found_"]["lang"] == "und") == (not lettered)
        assert r["found"] == "mine"


def test_copies_agree_whatever_their_neighbours(spark, rows):
    model = language.train(language.samples_of(rows, "doc_id", "text", "lang"))
    twice = rows.unionByName(rows).repartition(5)
    got = {}
    for r in language.with_language(twice, "f", model).collect():
        assert abs(got.setdefault(r["doc_id"], r["f"]["score"]) - r["f"]["score"]) < 1e-6


def test_whole_text_counts(spark, rows):
    model = language.train(language.samples_of(rows, "doc_id", "text", "lang"))
    text = "the tioning " * 5 + "keitsch zuü " * 2000
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert language.with_language(one, "f", model).first()["f"]["lang"] == "cc"


def test_nothing_to_learn_from(none, odd):
    assert language.identify(none, "found").collect() == []
    got = language.identify(odd.withColumn("lang", F.lit(None).cast("string")), "found").collect()
    assert {(r["found"]["lang"], r["found"]["score"]) for r in got} == {("und", 0.0)}


def test_stage_keeps_columns_and_lettered_texts(rows, odd):
    kept = language.keep_identified(rows)
    assert kept.columns == rows.columns
    assert kept.count() == rows.count()
    assert language.keep_identified(odd).where("text is null or text = '' or text like '...%'").count() == 0


def test_stage_keeps_texts_in_several_languages(spark):
    syllables = {**SYLLABLES, "dd": ["ова", "ни", "ст", "жи"], "ee": ["ões", "nh", "lh", "qua"]}
    rng = random.Random(5)
    text = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    labelled = [(i, text(lang, rng.randrange(3, 120)), lang) for i in range(600) for lang in [rng.choice(sorted(syllables))]]
    share = lambda lang: text(lang, 900).encode()[:3840].decode(errors="ignore")
    mixed = [(1000, " ".join(map(share, sorted(syllables))), None), (1001, " ".join(map(share, ("aa", "bb", "cc"))), None)]
    rows = spark.createDataFrame(labelled + mixed, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["f"] for r in language.identify(rows, "f").where("doc_id >= 1000").collect()}
    assert all(f["score"] < 0.4 < f["sure"] for f in found.values())
    assert {r["doc_id"] for r in language.keep_identified(rows).where("doc_id >= 1000").collect()} == {1000, 1001}


def test_stage_rejects_nothing_without_a_model(odd):
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    kept = language.keep_identified(unlabelled)
    assert kept.columns == unlabelled.columns
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, unlabelled.collect()))


def test_forward_pass_against_a_plain_convolution():
    """The table look-ups give what a convolution over one-hot bytes gives, place by place."""
    rng = np.random.default_rng(4)
    model = language.train([(name, bytes(rng.integers(low, low + 12, 90, dtype=np.uint8))) for name, low in (("a", 97), ("b", 105), ("c", 112)) for _ in range(20)])
    texts = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (0, 1, 5, 127, 128, 129, 300)] + ["Ünï Çödé 中".encode()]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    w, owner = language.windows(raw, np.cumsum([0, *map(len, texts)]))
    got = language.Scorer(model).probabilities(w)
    for p, window in zip(got, w, strict=True):
        hot = np.eye(256)[window]
        pooled = [max(float((hot[i : i + width] * f[:, :, c]).sum()) for i in range(language.LENGTH)) for f, width in zip(model.filters, language.WIDTHS, strict=True) for c in range(language.FILTERS)]
        z = np.maximum(np.array(pooled) + model.shift, 0) @ model.out + model.bias
        plain = np.exp(z - z.max())
        assert np.allclose(p, plain / plain.sum(), atol=1e-4)
    folded = [bytes(c + 32 if 65 <= c <= 90 else c for c in t) for t in texts]
    for i, t in enumerate(folded):
        own = w[owner == i]
        assert own[:, : language.LENGTH].tobytes().rstrip(b"\0") == t.rstrip(b"\0")


def test_every_label_is_learned(spark):
    """Three hundred labels, each with a word of its own: none is left out."""
    names = [f"l{i:03d}" for i in range(300)]
    rows = [(i * 10 + k, f"{n} {n}{n} " * 12, n) for i, n in enumerate(names) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {lang for lang, _ in language.samples_of(docs, "doc_id", "text", "lang")} == set(names)


def test_too_many_labels_raise(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LABELS", 3)
    docs = spark.createDataFrame([(i, "a text", f"l{i}") for i in range(40)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="labels"):
        language.samples_of(docs, "doc_id", "text", "lang")
