"""Registered queries over stored indexes, files and change feeds, and the SQL for them.

They write below the shared folder, as a store does, and read back what they wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.scoring import SHOWN_DIGITS
from ..operators import lexical
from ..schemas import DELETE, UPSERT
from ..shared import new_folder
from ..sources import tables
from ..sources.files import scan_directory
from ..streaming.live import LiveIndex, change_feed
from . import oracles as sql
from .registry import query, table
from .service import console_line, tool_line
from .snapshot import Index, Store, build

TOP = 10
REVISED = " revised edition"


def _documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def _saved(spark, records: DataFrame) -> Store:
    store = Store(spark, new_folder(spark, "store"))
    store.save(build(records, shards=8), 8)
    return store


def _contents(index: Index) -> DataFrame:
    """What a store holds of each record: its columns, lengths, numbers of terms and vectors."""
    rows = index.records.select("id", "source", "location", "title", "language", F.md5(F.col("text").cast("binary")).alias("digest"))
    for part in ("body", "path"):
        rows = rows.join(index.tables[f"{part}_lengths"].select("id", F.col("dl").alias(f"{part}_dl")), "id", "left")
        terms = index.tables[f"{part}_postings"].groupBy("id").agg(F.count(F.lit(1)).alias(f"{part}_terms"))
        rows = rows.join(terms, "id", "left").fillna(0, [f"{part}_terms"])
    return rows.join(index.vectors.groupBy("id").agg(F.count("embedding").alias("n_vectors")), "id", "left")


_CONTENTS = f"""{sql.postings("body_docs", "body")}, {sql.postings("path_docs", "path")},
body_n_terms as (select id, count(*) n from body_tf group by id), path_n_terms as (select id, count(*) n from path_tf group by id)
select r.id, r.source, r.location, r.title, r.language, md5(r.text) digest, b.dl body_dl, p.dl path_dl, coalesce(x.n, 0)::bigint body_terms, coalesce(y.n, 0)::bigint path_terms, 1::bigint n_vectors
from records r join body_dl b on b.id = r.id join path_dl p on p.id = r.id left join body_n_terms x on x.id = r.id left join path_n_terms y on y.id = r.id"""


@query(f"with {sql.RECORDS}, {_CONTENTS}")
def store_save_load(spark, sf_dir):
    """All documents saved as an index of eight shards, and what a reader then finds."""
    return _contents(_saved(spark, tables.document_records(_documents(spark, sf_dir))).load())


@query(f"""with changed as (select doc_id, case when lang = 'fr' then text || '{REVISED}' else text end as text, lang, source from documents where not coalesce(source = 'src1', false) or coalesce(lang = 'fr', false)),
{sql.RECORDS.replace("from documents", "from changed")}, {_CONTENTS}""")
def store_add_remove(spark, sf_dir):
    """A stored index from which one source is removed, to which revised texts of one language are
    added: they replace those that are there."""
    docs = _documents(spark, sf_dir)
    store = _saved(spark, tables.document_records(docs))
    store.remove(docs.where("source = 'src1'").select(F.col("doc_id").alias("id")))
    store.add(tables.document_records(docs.where("lang = 'fr'").withColumn("text", F.concat("text", F.lit(REVISED)))))
    return _contents(store.load())


@query(f"""with {sql.RECORDS}, asked as (select item_id query_id, text t from benchmark), {sql.bm25("asked", "body_docs", "d", TOP)}
select query_id item_id, id, rank::int rank, round(score, 6) score from d_top""")
def store_bm25_topk(spark, sf_dir):
    """Every benchmark text searched in the postings of a stored index."""
    index = _saved(spark, tables.document_records(_documents(spark, sf_dir))).load()
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    top = lexical.bm25_top(lexical.QueryTerms(asked), index.body_postings, index.stats("body"), TOP)
    return top.select(F.col("query_id").alias("item_id"), "id", "rank", F.round("score", SHOWN_DIGITS).alias("score"))


@query(f"""with {sql.RECORDS},
now as (select location, title, 'und' as language, text || '{REVISED}' t from records where source = 'file' and language = 'fr'
  union all select location, title, language, text from records where not coalesce(source = 'file' and (coalesce(language in ('fr', 'de'), false) or starts_with(location, 'src2/')), false))
select location, title, language, md5(t) digest from now""")
def live_changes(spark, sf_dir):
    """A stored index kept in step with a streamed feed: files of one language are deleted and
    made anew, those of another deleted, and a directory goes with all below it."""
    records = tables.document_records(_documents(spark, sf_dir))
    store = _saved(spark, records)
    files = records.where("source = 'file'").withColumn("path", tx.location_path("location"))
    first, n = files.where("language in ('fr', 'de')"), F.col("id") * 2
    feed = first.select(n.alias("seq"), "path", F.lit(DELETE).alias("kind"))
    feed = feed.unionByName(first.where("language = 'fr'").select((n + 1).alias("seq"), "path", F.lit(UPSERT).alias("kind")))
    feed = feed.unionByName(spark.createDataFrame([(-1, "src2", DELETE)], feed.schema))
    folder = new_folder(spark, "feed")
    feed.write.json(folder)

    def passages_of(paths: DataFrame) -> DataFrame:
        found = files.join(paths, "path", "left_semi")
        return found.select("source", "location", "title", F.concat("text", F.lit(REVISED)).alias("text"))

    live = LiveIndex(store, passages_of)
    running = live.start(change_feed(spark, folder), new_folder(spark, "checkpoint"))
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return live.index().records.select("location", "title", "language", F.md5(F.col("text").cast("binary")).alias("digest"))


_FILES = sql.PASSAGES.replace("with recursive", "with recursive files as (select item_id doc_id, text || chr(10) as text from benchmark),").replace("from documents", "from files")


@query(_FILES + "select 'file' source, doc_id item_id, start_line, end_line, md5(passage) digest from texts where passage <> ''")
def file_scan(spark, sf_dir):
    """The benchmark as a folder of text files, one an item, scanned for passages."""
    folder = new_folder(spark, "files")
    table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), "text").write.partitionBy("item").text(folder)
    found = scan_directory(spark, folder)
    part = lambda n: F.regexp_extract("location", r"item=(-?\d+)/.*:(\d+)-(\d+)$", n)
    return found.select("source", part(1).cast("long").alias("item_id"), part(2).cast("int").alias("start_line"), part(3).cast("int").alias("end_line"), F.md5(F.col("text").cast("binary")).alias("digest"))


# --- rendering

_cut = lambda c, most: f"case when length({c}) > {most} then substr({c}, 1, {most - 1}) || '…' else {c} end"
_SHOWN = f"""with {sql.RECORDS}, shown as (select id, printf('%6.3f', id / 8::double) || '  [' || language || ']  ' || source || ':' || location head,
trim(regexp_replace(title, '\\r\\n|\\r|\\n', ' ', 'g')) a, trim(regexp_replace(text, '\\r\\n|\\r|\\n', ' ', 'g')) b from records)"""


def _scored(spark, sf_dir) -> DataFrame:
    return tables.document_records(_documents(spark, sf_dir)).withColumn("score", F.col("id") / 8)


@query(f"{_SHOWN} select id, head || chr(10) || '        ' || {_cut('a', 90)} || chr(10) || '        ' || {_cut('b', 90)} as line from shown")
def console_render(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", console_line().alias("line"))


@query(f"{_SHOWN} select id, head || case when a <> '' then chr(10) || '    ' || {_cut('a', 90)} else '' end || chr(10) || '    ' || {_cut('b', 200)} as line from shown")
def tool_render(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", tool_line().alias("line"))


@query("select doc_id, lang as label from documents")
def label_strip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.strip_label(F.concat(F.lit("__label__"), "lang")).alias("label"))
