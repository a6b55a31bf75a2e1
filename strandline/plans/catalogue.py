"""Registered queries over the test tables, and the SQL that must return the same rows."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.scoring import SHOWN_DIGITS
from ..operators import changes, fusion, language, lexical, vectors
from ..sources import tables
from ..sources.files import EXTENSIONS, SKIPPED, in_skipped, is_text
from ..sources.git import FIELD, RECORD, parse_log
from . import oracles as sql
from . import stored  # noqa: F401 - registers its queries
from .registry import ORACLES, QUERIES, query  # noqa: F401
from .registry import table as _table
from .snapshot import Index

TEXT_QUERY = "the tion and doc12 src3 onand"
URL_QUERY = "example blog en tionsh 25"
VECTOR_ID = 7
TOP = 10


def _docs(spark, sf_dir: str) -> DataFrame:
    return lexical.by_document(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


def _shown(c: str = "score"):
    return F.round(c, SHOWN_DIGITS).alias(c)


_DOCS = "docs as (select doc_id id, text t from documents)"


# --- tokens and statistics


@query(rf"""with runs as (select doc_id, regexp_extract_all(text, '{sql.RUN}') r from documents),
toks as (select doc_id, flatten(list_transform(r, lambda x: case when len(regexp_extract_all(x, '{sql.PIECE}')) > 1 then list_append(regexp_extract_all(x, '{sql.PIECE}'), x) else regexp_extract_all(x, '{sql.PIECE}') end)) t from runs)
select doc_id, (unnest(generate_series(1, len(t))) - 1)::int pos, lower(unnest(t)) term from toks""")
def tokenize_explode(spark, sf_dir):
    return lexical.tokenize(_docs(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query(f"with {_DOCS}, {sql.postings('docs', 'd')} select id doc_id, term, tf from d_tf")
def term_frequency(spark, sf_dir):
    return lexical.term_frequencies(_docs(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query(f"with {_DOCS}, {sql.postings('docs', 'd')} select id doc_id, dl from d_dl")
def doc_length(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return lexical.lengths(docs, lexical.term_frequencies(docs)).withColumnRenamed("id", "doc_id")


@query(f"with {_DOCS}, {sql.postings('docs', 'd')} select term, count(*) df from d_tf group by term")
def doc_frequency(spark, sf_dir):
    return lexical.document_frequencies(lexical.term_frequencies(_docs(spark, sf_dir)))


@query(f"with {_DOCS}, {sql.postings('docs', 'd')} select n, sum(dl)::bigint total, round(avgdl, 6) avgdl from d_dl cross join d_n group by n, avgdl")
def corpus_stats(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    stats = lexical.collection_stats(lexical.lengths(docs, lexical.term_frequencies(docs)))
    return stats.withColumn("avgdl", F.round(F.col("total") / F.col("n"), SHOWN_DIGITS))


# --- text functions and sources


@query(sql.PASSAGES + "select doc_id, start_line, end_line, md5(passage) digest, length(passage) n_chars from texts where passage <> ''")
def passage_split(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.passage_array("text")).alias("p"))
    return rows.select("doc_id", F.col("p.start").alias("start_line"), F.col("p.end").alias("end_line"), F.md5(F.col("p.text").cast("binary")).alias("digest"), F.length("p.text").alias("n_chars"))


@query(r"""select doc_id, case when length(t) > 90 then substr(t, 1, 89) || '…' else t end snippet
from (select doc_id, trim(regexp_replace(text, '\r\n|\r|\n', ' ', 'g')) t from documents)""")
def snippet_render(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", tx.snippet("text", 90).alias("snippet"))


@query(f"with {sql.RECORDS} select r.id, p.t path_text, length(b.t)::int body_chars from records r join path_docs p using (id) join body_docs b using (id)")
def path_text(spark, sf_dir):
    records = tables.document_records(_table(spark, sf_dir, "documents"))
    return records.select("id", tx.path_text().alias("path_text"), F.length(tx.body_text()).alias("body_chars"))


@query(r"""select page_id, regexp_replace(url, '(?s)^(.+):[^:]*$', '\1') path, regexp_replace(url, '^http:/', '') below from pages""")
def location_parse(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", tx.location_path("url").alias("path"), tx.relative_path("url", "http:/").alias("below"))


@query(r"""select doc_id, md5(trim(regexp_replace(text, '\r\n|[\n\r\f]', ' ', 'g'))) one_line from documents""")
def language_text(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.one_line("text").cast("binary")).alias("one_line"))


@query("""select 'chat' source, conv_id || '/' || turn as location, split_part(text, chr(10), 1) || '  (' || role || ')' title, text from conversations""")
def conversation_passages(spark, sf_dir):
    return tables.conversation_passages(_table(spark, sf_dir, "conversations"))


@query(r"""with f as (select substr(md5(conv_id || '/' || turn), 1, 7) as location, role author, split_part(text, chr(10), 1) subject, trim(substr(text, length(split_part(text, chr(10), 1)) + 1), ' ' || chr(9) || chr(10) || chr(13)) body from conversations)
select 'git' source, location, subject || '  (' || author || ', 2024-01-01)' title, case when body = '' then subject else subject || chr(10) || chr(10) || body end as text from f""")
def commit_log_parse(spark, sf_dir):
    """Turns written as log records, then parsed as commits."""
    turns = _table(spark, sf_dir, "conversations")
    subject = F.substring_index("text", "\n", 1)
    key = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    fields = [F.substring(F.md5(key.cast("binary")), 1, 7), F.col("role"), F.lit("2024-01-01"), subject, F.substring(F.col("text"), F.length(subject) + 1, F.length("text"))]
    return parse_log(turns.select(F.concat(F.concat_ws(FIELD, *fields), F.lit(RECORD + "\n")).alias("value")))


_QUOTED = lambda words: ", ".join(f"'{w}'" for w in words)


@query(rf"""with p as (select page_id, regexp_replace(url, '^.*?://', '') || case page_id % 5 when 0 then '.md' when 1 then '/bin/a.cs' when 2 then '/dist.PY' when 3 then '.exe' else '' end as path from pages)
select page_id, path from p where lower(regexp_extract(path, '\.([^./\\]+)$', 1)) in ({_QUOTED(EXTENSIONS)}) and not list_has_any(string_split(lower(path), '/')[:-2], [{_QUOTED(SKIPPED)}])""")
def path_filter(spark, sf_dir):
    tail = F.element_at(F.array(*[F.lit(x) for x in (".md", "/bin/a.cs", "/dist.PY", ".exe", "")]), (F.col("page_id") % 5 + 1).cast("int"))
    paths = _table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("url", "^.*?://", ""), tail).alias("path"))
    return paths.where(is_text(F.col("path")) & ~in_skipped(F.col("path")))


# --- lexical search


def _one(spark, text: str) -> DataFrame:
    return spark.createDataFrame([(0, text)], "query_id long, text string")


def _kept(docs: DataFrame, text: str = "text") -> tuple[DataFrame, tuple[int, int]]:
    """Postings of texts that have no stored index, kept as the search reads them twice, and the
    statistics: the text is tokenized once. Executors put on disk what memory does not hold."""
    found = lexical.build(docs, text)[0].persist(StorageLevel.MEMORY_AND_DISK)
    return found, (docs.count(), found.agg(F.sum("tf")).first()[0] or 0)


def _bm25(spark, sf_dir, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    return lexical.bm25_top(lexical.QueryTerms(queries), *_kept(docs), k)


@query(f"with {_DOCS}, asked as (select 0 query_id, '{TEXT_QUERY}' t), {sql.bm25('asked', 'docs', 'd', TOP)} select id doc_id, rank::int rank, round(score, 6) score from d_top")
def bm25_topk(spark, sf_dir):
    top = _bm25(spark, sf_dir, _one(spark, TEXT_QUERY), _docs(spark, sf_dir), TOP)
    return top.select(F.col("id").alias("doc_id"), "rank", _shown())


@query(f"with {_DOCS}, asked as (select item_id query_id, text t from benchmark), {sql.bm25('asked', 'docs', 'd', TOP)} select query_id item_id, id doc_id, rank::int rank, round(score, 6) score from d_top")
def bm25_batch_topk(spark, sf_dir):
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    top = _bm25(spark, sf_dir, asked, _docs(spark, sf_dir), TOP)
    return top.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "rank", _shown())


@query(f"""with urls as (select page_id id, translate(regexp_replace(url, '^.*?://', ''), '/.', '  ') t from pages), asked as (select 0 query_id, '{URL_QUERY}' t), {sql.bm25("asked", "urls", "d", TOP)} select id page_id, rank::int rank, round(score, 6) score from d_top""")
def path_bm25_topk(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), tx.path_text(F.lit("file"), F.concat(F.regexp_replace("url", "^.*?://", ""), F.lit(":1-9")), F.lit("")).alias("text"))
    return _bm25(spark, sf_dir, _one(spark, URL_QUERY), pages, TOP).select(F.col("id").alias("page_id"), "rank", _shown())


# --- vectors


def _vectors(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


_VECTORS = "vecs as (select vec_id id, embedding from embeddings)"
_ONE_VECTOR = f"asked as (select 0 query_id, embedding v from embeddings where vec_id = {VECTOR_ID})"


def _one_vector(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").where(F.col("vec_id") == VECTOR_ID).select(F.lit(0).cast("long").alias("query_id"), F.col("embedding").alias("vector"))


@query(f"with {_VECTORS}, {_ONE_VECTOR}, {sql.cosine('asked', 'vecs', 'v', TOP)} select id vec_id, rank::int rank, round(score, 6) score from v_top")
def vector_topk(spark, sf_dir):
    return vectors.cosine_top(_one_vector(spark, sf_dir), _vectors(spark, sf_dir), TOP).select(F.col("id").alias("vec_id"), "rank", _shown())


@query(f"with {_VECTORS}, asked as (select vec_id query_id, embedding v from embeddings where vec_id % 50 = 0), {sql.cosine('asked', 'vecs', 'v', TOP)} select query_id, id vec_id, rank::int rank, round(score, 6) score from v_top")
def vector_batch_topk(spark, sf_dir):
    asked = _table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vectors.cosine_top(asked, _vectors(spark, sf_dir), TOP).select("query_id", F.col("id").alias("vec_id"), "rank", _shown())


@query(f"with vecs as (select vec_id id, embedding from embeddings join documents on doc_id = vec_id where lang = 'en' and source = 'src3'), {_ONE_VECTOR}, {sql.cosine('asked', 'vecs', 'v', TOP)} select id vec_id, rank::int rank, round(score, 6) score from v_top")
def vector_topk_filtered(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), "source")
    allowed = fusion.matching(docs, "en", "src3")
    return vectors.cosine_top(_one_vector(spark, sf_dir), _vectors(spark, sf_dir), TOP, allowed).select(F.col("id").alias("vec_id"), "rank", _shown())


@query("select md5(text) digest, count(*) copies from documents group by text")
def dedupe_text_for_embedding(spark, sf_dir):
    return vectors.distinct_texts(_table(spark, sf_dir, "documents").select("text")).select(F.md5(F.col("text").cast("binary")).alias("digest"), "copies")


def _hash_sql(name: str, key: str) -> str:
    return f"""with src as (select {key} id, text t from {name}), {sql.tokens("src")},
h as (select id, md5(term) m from tok),
b as (select id, ('0x' || substr(m, 1, 4))::int % 64 bucket, sum(case when ('0x' || substr(m, 5, 2))::int % 2 = 0 then 1.0::double else -1.0::double end) v from h group by all),
n as (select id, sqrt(sum(v * v)) size from b group by id)
select id {key}, bucket, round((v / size)::float::double, 6) value from b join n using (id) where v <> 0 and size > 0"""


def _hashed(spark, sf_dir, name: str, key: str) -> DataFrame:
    docs = _table(spark, sf_dir, name).select(F.col(key).alias("id"), "text")
    rows = vectors.embed(docs, vectors.HashingEmbedder()).select(F.col("id").alias(key), F.posexplode("embedding").alias("bucket", "value"))
    return rows.where("value <> 0").select(key, "bucket", F.round(F.col("value").cast("double"), SHOWN_DIGITS).alias("value"))


@query(_hash_sql("benchmark", "item_id"))
def hash_embedding(spark, sf_dir):
    return _hashed(spark, sf_dir, "benchmark", "item_id")


@query(_hash_sql("documents", "doc_id"))
def document_embedding(spark, sf_dir):
    return _hashed(spark, sf_dir, "documents", "doc_id")


# --- hybrid search


def _index(spark, sf_dir) -> Index:
    records = lexical.by_document(tables.document_records(_table(spark, sf_dir, "documents")))
    body, body_stats = _kept(records.select("id", tx.body_text().alias("t")), "t")
    path, path_stats = _kept(records.select("id", tx.path_text().alias("t")), "t")
    pool = _vectors(spark, sf_dir).join(records.select("id"), "id", "left_semi")
    return Index({"records": records, "body_postings": body, "path_postings": path, "vectors": pool}, True, stats={"body": body_stats, "path": path_stats})


def _hybrid(spark, sf_dir, language=None, source=None) -> DataFrame:
    asked = _one_vector(spark, sf_dir).withColumn("text", F.lit(TEXT_QUERY))
    best = fusion.hybrid_top(asked, _index(spark, sf_dir), TOP, language, source)
    return best.select("query_id", "rank", "id", "source", "location", "title", "language", F.round("fused", SHOWN_DIGITS).alias("score"))


_ASKED = f"select 0 query_id, '{TEXT_QUERY}' t, embedding v from embeddings where vec_id = {VECTOR_ID}"


@query(sql.hybrid(_ASKED, 100, TOP))
def hybrid_search(spark, sf_dir):
    return _hybrid(spark, sf_dir)


@query(sql.hybrid(_ASKED, 100, TOP, language="en"))
def hybrid_search_lang(spark, sf_dir):
    return _hybrid(spark, sf_dir, language="en")


@query(sql.hybrid(_ASKED, 100, TOP, source="git"))
def hybrid_search_source(spark, sf_dir):
    return _hybrid(spark, sf_dir, source="git")


_BATCH = "select item_id query_id, text t, embedding v from benchmark join embeddings on vec_id = item_id"


@query(sql.hybrid(_BATCH, 50, 5))
def hybrid_batch_search(spark, sf_dir):
    asked = _table(spark, sf_dir, "benchmark").join(_vectors(spark, sf_dir), F.col("item_id") == F.col("id")).select(F.col("item_id").alias("query_id"), "text", F.col("embedding").alias("vector"))
    best = fusion.hybrid_top(asked, _index(spark, sf_dir), 5)
    return best.select("query_id", "rank", "id", "source", "location", "title", "language", F.round("fused", SHOWN_DIGITS).alias("score"))


@query(f"""with {_DOCS}, {_VECTORS}, {_ONE_VECTOR}, words as (select 0 query_id, '{TEXT_QUERY}' t),
{sql.cosine("asked", "vecs", "vec", 50)}, {sql.bm25("words", "docs", "body", 50)},
lists as (select id, score, rank, 'vector' l from vec_top union all select id, score, rank, 'body' from body_top)
select id, round(sum(1.0::double / (60 + rank)), 6) fused, round(coalesce(max(score) filter (where l = 'body'), 0), 6) body, round(coalesce(max(score) filter (where l = 'vector'), 0), 6) vector from lists group by id""")
def rrf_fusion(spark, sf_dir):
    lists = {"vector": vectors.cosine_top(_one_vector(spark, sf_dir), _vectors(spark, sf_dir), 50), "body": _bm25(spark, sf_dir, _one(spark, TEXT_QUERY), _docs(spark, sf_dir), 50)}
    return fusion.fuse(lists).select("id", _shown("fused"), _shown("body"), _shown("vector"))


# --- metadata


@query("select doc_id id, lang as language, source from documents where lang = 'fr' and source = 'src0'")
def metadata_filter(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), "source")
    return fusion.matching(docs, "fr", "src0")


@query("select source, lang, count(*) n from documents group by source, lang")
def source_lang_count(spark, sf_dir):
    return _table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {sql.RECORDS} select source, count(*) n, count(distinct regexp_replace(location, '^(.+):[^:]*$', '\\1')) files from records group by source")
def distinct_files(spark, sf_dir):
    records = tables.document_records(_table(spark, sf_dir, "documents"))
    return records.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(tx.location_path("location")).alias("files"))


@query("select source as path, string_agg(doc_id::varchar, ',' order by doc_id) ids from documents group by source")
def ids_by_file(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("path"))
    return docs.groupBy("path").agg(F.array_join(F.sort_array(F.collect_list("id")).cast("array<string>"), ",").alias("ids"))


@query("select doc_id % 8 shard, count(*) n, sum(n_chars)::bigint chars from documents group by 1")
def shard_counts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.groupBy((F.col("doc_id") % 8).alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query(f"select (x % 8)::int shard, count(*) n from ({sql.hashed('documents', 'doc_id')}) group by 1")
def hash_shard_counts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.groupBy(tx.shard_of("doc_id", 8).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with train as (select doc_id id, text t, lang from documents where lang is not null), test as (select doc_id id, text t from documents),
{sql.postings("train", "a")}, {sql.postings("test", "b")},
c as (select lang, term, sum(tf) c from a_tf join train using (id) group by all),
l as (select lang, ln(docs::double / sum(docs) over ()) prior, ln((tokens + (select count(distinct term) from c))::double) floor
  from (select lang, count(*) docs from train group by lang) join (select lang, sum(c) tokens from c group by lang) using (lang)),
k as (select id, lang, sum(tf * ln(c + 1.0::double)) s from b_tf join c using (term) group by all),
s as (select d.id, l.lang, prior + coalesce(s, 0) - dl * floor score from b_dl d cross join l left join k on k.id = d.id and k.lang = l.lang where dl > 0),
best as (select id, lang from (select *, row_number() over (partition by id order by round(score, 9) desc, lang) n from s) where n = 1)
select test.id doc_id, coalesce(lang, 'und') as language from test left join best using (id)""")
def language_id_nb_all(spark, sf_dir):
    """A prediction for every document, learned from all labelled ones."""
    docs = lexical.by_document(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("language")))
    model = language.NaiveBayes(docs.where("language is not null"))
    return model.predict(docs.select("id", "text")).withColumnRenamed("id", "doc_id")


# --- change feeds

_FEED = """feed as (select user_id as path, event_id seq, case when event_type = 'error' then 'Delete' else 'Upsert' end kind, value, ts from events)"""


def _feed(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "Delete").otherwise("Upsert")
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("seq"), kind.alias("kind"), "value", "ts")


@query(f"with {_FEED} select path, seq, kind from (select *, row_number() over (partition by path order by ts desc, seq desc) n from feed) where n = 1")
def change_coalesce(spark, sf_dir):
    return changes.coalesce_changes(_feed(spark, sf_dir), order=["ts", "seq"]).select("path", "seq", "kind")


@query(f"""with {_FEED}, half as (select max(seq) // 2 h from feed),
last as (select *, seq <= h early from feed cross join half qualify row_number() over (partition by path, seq <= h order by seq desc) = 1),
base as (select path, seq, value from last where early and kind = 'Upsert'), burst as (select * from last where not early)
select path, seq, round(value, 6) value from base where path not in (select path from burst) union all select path, seq, round(value, 6) from burst where kind = 'Upsert'""")
def incremental_upsert(spark, sf_dir):
    feed = _feed(spark, sf_dir)
    half = feed.agg(F.floor(F.max("seq") / 2).alias("h"))
    feed = feed.crossJoin(F.broadcast(half))  # one row
    base, _ = changes.split_changes(changes.coalesce_changes(feed.where("seq <= h")))
    burst = changes.coalesce_changes(feed.where("seq > h"))
    fresh, _ = changes.split_changes(burst)
    return changes.upsert(base.select("path", "seq", "value"), burst, fresh, "path").select("path", "seq", F.round("value", SHOWN_DIGITS).alias("value"))


@query("""with p as (select page_id, regexp_replace(url, '^.*?://', '') as path from pages), d as (select distinct split_part(path, '/', 1) || '/en' gone from p where page_id % 3 = 0)
select page_id, path from p where not exists (select 1 from d where path = gone or starts_with(path, gone || '/'))""")
def subtree_delete(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^.*?://", "").alias("path"))
    gone = pages.where("page_id % 3 = 0").select(F.concat(F.substring_index("path", "/", 1), F.lit("/en")).alias("path"))
    return changes.without_subtrees(pages, gone)


@query("""select doc_id, '{"language":"' || lang || '","source":"' || source || '","doc_id":' || doc_id || '}' as line from documents""")
def json_lines(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.to_json(F.struct(F.col("lang").alias("language"), "source", "doc_id")).alias("line"))
