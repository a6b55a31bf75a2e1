from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import text as tx
from strandline.operators import fusion, lexical, vectors
from strandline.operators.language import NaiveBayes
from strandline.plans.service import SearchService, query_rows
from strandline.plans.snapshot import Index, ReadOnlyError, Store, build, to_records
from strandline.schemas import PASSAGE

PASSAGES = [
    ("file", "vectors.md:1-3", "Vector search", "Embeddings map text to vectors so that nearest neighbor similarity search finds related text."),
    ("file", "bm25.md:1-3", "Lexical search", "BM25 ranks documents by term frequency and inverse document frequency."),
    ("file", "cuisine.md:1-2", "Cooking", "Simmer the tomato sauce slowly and season with basil."),
    ("git", "abc1234", "Fix basil  (Ann, 2024-01-02)", "Fix basil"),
]


def bm25(spark, docs, query, k=10):
    df = spark.createDataFrame(docs, "id long, text string")
    found, dl = lexical.build(df)
    asked = spark.createDataFrame([(0, query)], "query_id long, text string")
    rows = lexical.bm25_top(lexical.QueryTerms(asked), found, lexical.stats_of(dl), k).orderBy("rank").collect()
    return [(r["id"], round(r["score"], 6)) for r in rows]


TWO = [(0, "vector database similarity search over embeddings"), (1, "the cat sat on the mat")]


def test_bm25_golden(spark):
    assert bm25(spark, TWO, "similarity search") == [(0, 1.386294)]
    three = [*TWO, (2, "reciprocal rank fusion blends lexical and vector signals")]
    assert bm25(spark, three, "vector similarity search") == [(0, 2.535382), (2, 0.434457)]
    assert bm25(spark, [(i, f"shared token doc number {i}") for i in range(5)], "shared token", 2) == [(0, 0.174023), (1, 0.174023)]


def test_query_repeats_and_blanks(spark):
    assert bm25(spark, TWO, "the the") == bm25(spark, TWO, "the")
    assert bm25(spark, TWO, "  ") == []
    assert bm25(spark, TWO, "absent") == []


def test_empty_documents_count(spark):
    docs = spark.createDataFrame([(0, "a b"), (1, ""), (2, None)], "id long, text string")
    _, dl = lexical.build(docs)
    assert lexical.stats_of(dl) == (3, 2)
    assert lexical.stats_of(dl.limit(0)) == (0, 0)


def test_cosine_top_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id long, embedding array<float>")
    asked = df.where("id in (3, 4)").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    got = vectors.cosine_top(asked, df, 5).orderBy("query_id", "rank").collect()
    n = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    for q in (3, 4):
        assert [r["id"] for r in got if r["query_id"] == q] == np.lexsort((np.arange(200), -np.round(n @ n[q], 9)))[:5].tolist()


def test_cosine_ties_filter_and_zero(spark):
    df = spark.createDataFrame([(2, [1.0, 0.0]), (1, [2.0, 0.0]), (3, [0.0, 0.0])], "id long, embedding array<float>")
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<float>")
    assert [r["id"] for r in vectors.cosine_top(asked, df, 3).orderBy("rank").collect()] == [1, 2, 3]
    assert [r["id"] for r in vectors.cosine_top(asked, df, 1, df.where("id = 3")).collect()] == [3]


def test_embedding_order_and_copies(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7}") for i in range(101)], "id long, text string")
    got = {r["id"]: r["embedding"] for r in vectors.embed(docs, vectors.HashingEmbedder(16)).collect()}
    assert len(got) == 101
    assert all(got[i] == got[i % 7] for i in range(101))
    assert math.isclose(sum(v * v for v in got[0]), 1.0, rel_tol=1e-5)


def test_static_embedder(spark, tmp_path):
    (tmp_path / "v.txt").write_text("red\nblue\n")
    np.save(tmp_path / "m.npy", np.eye(2, dtype=np.float32))
    e = vectors.StaticEmbedder(str(tmp_path / "v.txt"), str(tmp_path / "m.npy"))
    docs = spark.createDataFrame([(0, "Red red"), (1, "blue"), (2, "green")], "id long, text string")
    assert {r["id"]: r["embedding"] for r in vectors.embed(docs, e).collect()} == {0: [1.0, 0.0], 1: [0.0, 1.0], 2: [0.0, 0.0]}
    with pytest.raises(FileNotFoundError):
        vectors.StaticEmbedder(str(tmp_path / "none"), str(tmp_path / "m.npy"))


def test_rrf_invariants(spark):
    one = spark.createDataFrame([(0, 7, 0.5, 1)], "query_id long, id long, score double, rank int")
    assert round(fusion.fuse({"vector": one}).first()["fused"], 6) == 0.016393
    assert round(fusion.fuse({"vector": one, "body": one, "path": one}).first()["fused"], 6) == 0.065574


@pytest.fixture(scope="module")
def index(spark):
    records = to_records(spark.createDataFrame(PASSAGES, PASSAGE), F.lit("en"))
    return build(records)


def test_hybrid(spark, index):
    found = SearchService(spark, index).search("nearest neighbor similarity search").collect()
    assert found[0]["title"] == "Vector search"
    assert [r["rank"] for r in found] == [1, 2, 3, 4]


def test_filters(spark, index):
    service = SearchService(spark, index)
    assert [r["source"] for r in service.search("basil", source="git").collect()] == ["git"]
    assert service.search("basil", language="fr").collect() == []
    for bad in ({"query": " "}, {"query": "a", "source": "web"}, {"query": "a", "top": -1}):
        with pytest.raises(ValueError):
            service.search(**bad)


def test_rendering(spark, index):
    service = SearchService(spark, index)
    first = service.console("cooking tomato", top=1)
    assert "[en]  file:cuisine.md:1-2" in first
    assert first.splitlines()[1].strip() == "Cooking"
    assert "file:cuisine.md:1-2" in service.tool_text("cooking tomato", 1)
    assert '"title": "Cooking"' in service.respond('{"query": "tomato sauce", "top": 1}')
    assert "must not be blank" in service.respond('{"query": ""}')
    assert '"stopped": true' in service.respond('{"command": "stop"}')
    empty = Index({n: t.limit(0) for n, t in index.tables.items()})
    assert SearchService(spark, empty).console("anything") == "No matches."


def test_old_versions_go(spark, tmp_path, monkeypatch):
    from strandline.plans import snapshot
    from strandline.plans.snapshot import Store, build, to_records

    rows = spark.createDataFrame([("file", f"a{i}.md:1-1", "a", f"word{i} tomato") for i in range(6)], "source string, location string, title string, text string")
    monkeypatch.setattr(snapshot, "VERSIONS_KEPT", 2)
    store = Store(spark, f"file://{tmp_path}/kept")
    for _ in range(3):
        store.save(build(to_records(rows)), 2)
    assert sorted(p.name for p in (tmp_path / "kept").glob("manifest-*.json")) == ["manifest-2.json", "manifest-3.json"]
    assert store.load().count() == 6


def test_save_load_add_remove(spark, index, tmp_path):
    store = Store(spark, f"file://{tmp_path}/index")
    assert not store.exists()
    store.save(index, 3)
    loaded = store.load()
    asked = query_rows(spark, ["similarity search basil"])
    show = lambda i: [(r["location"], round(r["fused"], 6)) for r in fusion.hybrid_top(asked, i, 10, embedder=vectors.HashingEmbedder()).orderBy("rank").collect()]
    assert show(loaded) == show(index)
    assert store.manifest()["shards"] == 3
    with pytest.raises(ReadOnlyError):
        store.save(loaded)
    more = to_records(spark.createDataFrame([("file", "new.md:1-1", "New", "zebra crossing")], PASSAGE), F.lit("en"))
    store.add(more)
    after = store.load()
    assert after.count() == 5
    # as if it had been built at once
    whole = build(index.records.unionByName(more))
    assert show(after) == show(whole)
    store.add(more)  # again: replaced, not doubled
    assert store.load().count() == 5
    store.remove(more.select("id"))
    assert show(store.load()) == show(index)
    assert loaded.count() == 4  # a reader keeps its version
    assert store.load().body_postings.where("term = 'zebra'").count() == 0


def test_naive_bayes(spark):
    rows = [(0, "the quick brown fox", "en"), (1, "the lazy dog", "en"), (2, "le renard brun rapide", "fr"), (3, "le chien paresseux", "fr")]
    model = NaiveBayes(spark.createDataFrame(rows, "id long, text string, language string"))
    asked = spark.createDataFrame([(7, "The dog and the fox"), (8, "Le chien rapide"), (9, "---")], "id long, text string")
    assert {r["id"]: r["language"] for r in model.predict(asked).collect()} == {7: "en", 8: "fr", 9: "und"}


def test_a_vector_index_can_be_swapped(spark):
    index = build(to_records(spark.createDataFrame(PASSAGES, PASSAGE)))

    class Reversed:
        """The least similar first: what a search then finds shows that it was asked."""

        def top(self, queries, k, allowed=None, asked=None):
            flipped = index.vectors.withColumn("embedding", F.transform("embedding", lambda x: -x))
            return vectors.ExactVectors(flipped).top(queries, k, allowed, asked)

    exact = vectors.ExactVectors(index.vectors)
    asked = spark.createDataFrame([(0, [1.0] * 64)], "query_id long, vector array<double>")
    order = lambda found: [r["id"] for r in found.orderBy("rank").collect()]
    assert order(exact.top(asked, 4)) == order(exact.top(asked, 4, asked=asked.collect())) == order(vectors.cosine_top(asked, index.vectors, 4))
    assert order(Reversed().top(asked, 4)) == order(exact.top(asked, 4))[::-1]
    swapped = Index(index.tables, vector_index=Reversed())
    first = lambda i: SearchService(spark, i).search("nearest neighbor vectors", 4).collect()
    assert [r["fused"] for r in first(index)] != [r["fused"] for r in first(swapped)]


PASSAGE_COLUMNS = "id long, source string, location string, title string, language string, text string"


def _held(index):
    """Every row of every table, in the same form for any store."""
    return {n: sorted((tuple(map(str, r)) for r in t.select(sorted(set(t.columns) - {"shard"})).collect())) for n, t in index.tables.items()}


def _records(spark, ids, more=""):
    return spark.createDataFrame([(i, "file", f"src/doc{i}.md:1-2", f"doc{i}.md", "en", f"Tomato basil word{i % 7} fooBar{i} word{i % 7}{more}") for i in ids], PASSAGE_COLUMNS)


@pytest.mark.parametrize("limits", [{}, {"GONE": 5}, {"LAYERS": 1}])
def test_a_change_writes_what_is_new(spark, tmp_path, monkeypatch, limits):
    """Changes that touch every shard leave the shards as they are, until they are merged into them."""
    from strandline.plans import snapshot

    for name, value in limits.items():
        monkeypatch.setattr(snapshot, name, value)
    store = Store(spark, f"file://{tmp_path}/index")
    store.save(build(_records(spark, range(40)), shards=4), 4)
    first = store.manifest()["tables"]
    reader = store.load()
    store.remove(_records(spark, range(0, 40, 3)).select("id"))
    store.add(_records(spark, range(1, 50, 4), " revised"))
    assert (store.manifest()["tables"] == first) == (not limits)
    now = sorted({*range(40)} - {*range(0, 40, 3)} - {*range(1, 50, 4)})
    want = _held(build(_records(spark, now).unionByName(_records(spark, range(1, 50, 4), " revised"))))
    assert _held(store.load()) == want
    assert reader.count() == 40
    for _ in range(snapshot.LAYERS):
        store.add(_records(spark, range(1, 50, 4), " revised"))
    assert _held(store.load()) == want
    assert len(store.manifest()["layers"]) <= snapshot.LAYERS
    kept = {f for v in (tmp_path / "index").glob("manifest-*.json") for f in snapshot._folders(json.loads(v.read_text()))}
    assert all((tmp_path / "index" / f).exists() for f in kept)
    assert store.remove(_records(spark, [999]).select("id").limit(0)) == store.manifest()["version"]


def test_text_is_shuffled_once_on_its_way_to_a_store(spark):
    index = build(_records(spark, range(9)), shards=4)
    stored = index.source.withColumn("shard", F.lit(0))
    for name, table in index.derive(stored).items():
        assert "Exchange" not in table._jdf.queryExecution().executedPlan().toString(), name


def test_postings_in_place(spark):
    """In order by term, with runs that are sorted apart, as `build` makes them."""
    docs = _records(spark, range(30)).unionByName(spark.createDataFrame([(50, "file", "l", "", "en", ""), (51, "git", "l", "Ünï 中文", "en", "ß ẞ Iİ ΑΣ")], PASSAGE_COLUMNS))
    made = lexical.postings_in_place(docs.coalesce(1), tx.body_tokens())
    rows = [tuple(r) for r in made.select("term", "id", "tf", "dl").collect()]
    assert sorted(rows) == sorted(map(tuple, build(docs).body_postings.collect()))
    assert [r[0].encode() for r in rows] == sorted(r[0].encode() for r in rows)


def test_records_with_one_id_share_their_postings(spark, tmp_path):
    twice = _records(spark, [1, 2]).unionByName(_records(spark, [1]))
    store = Store(spark, f"file://{tmp_path}/index")
    store.save(build(twice, shards=2), 2)
    assert {tuple(r) for r in store.load().body_postings.where("id = 1 and term in ('tomato', 'word1')").select("term", "tf").collect()} == {("tomato", 2), ("word1", 4)}


def test_tokens_of_texts_with_runs_of_several_pieces(spark):
    """Letters without a known class, marks and letters beyond the basic plane are gaps."""
    texts = ["a\x01b fooBar12Baz", "xꟋy HTTPServer", "Ⅷa1 \U0001d400b ٣x", "abc def", "A1", None, " ", "É9é"]
    want = [["a", "b", "foo", "bar", "12", "baz", "foobar12baz"], ["x", "y", "httpserver"], ["a", "1", "a1", "b", "٣", "x", "٣x"], ["abc", "def"], ["a", "1", "a1"], [], [], ["é", "9", "é", "é9é"]]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r[0] for r in rows.orderBy("i").select(tx.token_array("t")).collect()] == want
