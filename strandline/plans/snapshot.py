"""The index as a versioned set of tables: build, save, load, add, remove."""

from __future__ import annotations

import contextlib
import json
import math
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import body_text, body_tokens, one_line, path_text, shard_of, token_array
from ..operators import lexical
from ..operators.sizes import arrow_bytes
from ..operators.vectors import Embedder, ExactVectors, HashingEmbedder, VectorIndex, embed
from ..schemas import LENGTHS, POSTING, RECORD, VECTOR

VERSIONS_KEPT = 5  # a reader of an older version must open the store again
SHARDS = 8
TASK_BYTES = 16 << 20  # of a table, as estimated, that one task writes
SHARD_TASKS = 64  # tasks that write a shard of a table, at most
OPEN_FILES = 16  # that a task writes side by side
LAYERS = 4  # changes that lie over the shards before they are merged into them
GONE = 1_000_000  # ids of records that layers hide, at most; every reader gets them all
TABLES = {"records": RECORD, "body_postings": POSTING, "path_postings": POSTING, "body_lengths": LENGTHS, "path_lengths": LENGTHS, "vectors": VECTOR}
SORTED_BY = {"records": "id", "body_postings": "term", "path_postings": "term", "body_lengths": "id", "path_lengths": "id", "vectors": "id"}


def shards_for(records: int) -> int:
    """Shards of a store of so many records: about a quarter of a million a shard."""
    return max(SHARDS, math.ceil(records / 250_000))


class ReadOnlyError(RuntimeError):
    """A read-only index was asked to change."""


class Index:
    """Six tables: records, postings and lengths for body and path, vectors."""

    def __init__(self, tables: dict[str, DataFrame], read_only: bool = False, shards: int | None = None, stats: dict[str, tuple[int, int]] | None = None, vector_index: VectorIndex | None = None):
        """``shards``: the tables have a column shard, of so many, and are partitioned by it.
        ``stats``: what `stats` would compute, if it is known. ``vector_index`` answers vector
        searches; without it the table of vectors is searched exactly."""
        self.tables, self.read_only, self.shards, self._stats = tables, read_only, shards, dict(stats or {})
        self.vector_index = vector_index or ExactVectors(tables.get("vectors"))
        self.source: DataFrame | None = None  # what `build` made it of
        self.derive: Callable[[DataFrame], dict[str, DataFrame]] | None = None  # the other tables, from stored records

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    def stats(self, part: str) -> tuple[int, int]:
        """(documents, tokens) of body or path; computed once, as an index does not change."""
        if part not in self._stats:
            self._stats[part] = lexical.stats_of(self.tables[f"{part}_lengths"])
        return self._stats[part]

    def cache(self) -> Index:
        """Keep the tables in executor memory: the resident form for many queries."""
        for t in self.tables.values():
            t.cache()
        return self

    def count(self) -> int:
        return self.records.count()


def record_id() -> F.Column:
    """A stable id from source, location, title and text; the same passage gets the same id."""
    return F.xxhash64("source", "location", "title", "text")


def to_records(passages: DataFrame, language=None) -> DataFrame:
    """Records of passages: an id, and a language.

    ``language`` is a column expression, or an object with predict(docs) such as NaiveBayes,
    which sees the text on one line; without it every language is ``und``. Equal passages are
    one record.
    """
    rows = passages.select(record_id().alias("id"), "source", "location", "title", "text").dropDuplicates(["id"])
    if language is None or isinstance(language, Column):
        rows = rows.withColumn("language", F.lit("und") if language is None else language)
    else:
        rows = rows.join(language.predict(rows.select("id", one_line("text").alias("text"))), "id")
    return rows.select([f.name for f in RECORD.fields])


def build(records: DataFrame, embedder: Embedder | None = None, text: str = "text", shards: int | None = None) -> Index:
    """The tables of an index of records. Body text has the title; vectors see the text alone.

    With ``shards``, records are shuffled to their shards first and every table but the vectors
    is built there, with a column shard; a store of so many shards writes them as they are.
    """
    columns, keys = [f.name for f in RECORD.fields], ("id",)
    source, embedder = records.select(columns), embedder or HashingEmbedder()
    if shards:
        records = records.select(*columns, shard_of("id", shards).alias("shard")).repartition(shards, "shard")
        keys = ("shard", "id")
    else:
        records = lexical.by_document(records.select(columns))
    body, body_dl = lexical.build(records.select(*keys, body_text().alias("t")), "t", keys)
    path, path_dl = lexical.build(records.select(*keys, path_text().alias("t")), "t", keys)
    vectors = embed(records, embedder, text)
    tables = {"records": records, "body_postings": body, "path_postings": path, "body_lengths": body_dl, "path_lengths": path_dl, "vectors": vectors}
    index = Index(tables, shards=shards)
    index.source, index.derive = source, lambda stored: _derived(stored, embedder, text)
    return index


def _derived(stored: DataFrame, embedder: Embedder, text: str) -> dict[str, DataFrame]:
    """Postings and vectors of stored records (with their column shard) of which no two have the
    same id, made where the records are."""
    arrow_bytes(stored.sparkSession)
    keys = ("shard", "id")
    body, path = (lexical.postings_in_place(stored, t, keys) for t in (body_tokens(), token_array(path_text())))
    light = getattr(embedder, "light", False)
    vectors = stored.select(*keys, embedder.column(F.col(text)).alias("embedding")) if light else embed(stored, embedder, text)
    return {"body_postings": body, "path_postings": path, "vectors": vectors}


def _layers(about: dict) -> list[dict]:
    """The shards of a version, and the changes that lie over them, oldest first."""
    return [{"tables": about["tables"]}, *about.get("layers", [])]


def _folders(about: dict) -> set[str]:
    found = {place for layer in _layers(about) for places in layer["tables"].values() for place in places.values()}
    return found | {layer["gone"] for layer in about.get("layers", [])}


@contextlib.contextmanager
def _open_files(spark: SparkSession, shards: int):
    """A task that writes shards has their files open side by side: Spark would sort it by shard else."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(shards, OPEN_FILES)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _dealt(df: DataFrame, shards: int) -> DataFrame:
    """``df`` with its column shard, each shard in as many tasks as the size asks for."""
    size, cores = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), df.sparkSession.sparkContext.defaultParallelism
    tasks = min(SHARD_TASKS, max(math.ceil(cores / shards), math.ceil(size / TASK_BYTES / shards)))
    shard = shard_of("id", shards)
    return df.withColumn("shard", shard).repartitionById(shards * tasks, shard * tasks + F.pmod(F.hash("id"), F.lit(tasks)))


class Store:
    """An index in a folder, in immutable versions.

    A version is a manifest that names, for every table and shard, the folder that holds it; a
    record's shard is the hash of its id. A change is a layer: the tables of what it adds, and the
    ids that it hides in what lies below. After LAYERS changes, or GONE ids, the shards that they
    touch are written anew. The file CURRENT, replaced last, makes a version visible. Readers keep
    the version they opened. All files go through the cluster's file system.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        """Whole under another name first, then renamed over."""
        temporary, final = self._path(f"{self.root}/{name}.tmp-{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}")
        stream = self._fs.create(temporary, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self._fs.rename(temporary, final):
            self._fs.delete(final, False)
            if not self._fs.rename(temporary, final):
                raise OSError(f"cannot put {name} in place")

    def exists(self) -> bool:
        return bool(self._fs.exists(self._path(f"{self.root}/CURRENT")))

    def manifest(self) -> dict:
        return json.loads(self._read(f"manifest-{self._read('CURRENT').strip()}.json"))

    def _commit(self, about: dict) -> None:
        self._write(f"manifest-{about['version']}.json", json.dumps(about))
        self._write("CURRENT", str(about["version"]))
        self._retire()

    def _retire(self) -> None:
        """Delete versions before the last VERSIONS_KEPT, and the folders that only they have."""
        files = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        versions = sorted(int(f[9:-5]) for f in files if f.startswith("manifest-") and f.endswith(".json"))
        folders = lambda v: _folders(json.loads(self._read(f"manifest-{v}.json")))
        held = {f for v in versions[-VERSIONS_KEPT:] for f in folders(v)}
        for v in versions[:-VERSIONS_KEPT]:
            for place in folders(v) - held:
                self._fs.delete(self._path(f"{self.root}/{place}"), True)
            self._fs.delete(self._path(f"{self.root}/manifest-{v}.json"), False)

    def _put(self, index: Index, version: int, shards: int) -> dict[str, dict[str, str]]:
        """Write the tables, a folder per shard: sorted, so that parquet statistics find a term.

        Records are written first. If their ids differ, the tables made of them are made of what
        is stored, so that the text is shuffled once.
        """
        folder = f"v{version}-{uuid.uuid4().hex[:8]}"
        places: dict[str, dict[str, str]] = {}

        def put(name: str, df: DataFrame, in_shards: bool, in_order: bool = False) -> DataFrame:
            if "shard" not in df.columns or not in_shards:
                df = _dealt(df.drop("shard"), shards)
            to = f"{self.root}/{folder}/{name}"
            df = df if in_order else df.sortWithinPartitions("shard", SORTED_BY[name])
            df.write.partitionBy("shard").option("parquet.bloom.filter.enabled#term", "true").parquet(to)
            names = [s.getPath().getName() for s in self._fs.listStatus(self._path(to))]
            places[name] = {n.removeprefix("shard="): f"{folder}/{name}/{n}" for n in names if n.startswith("shard=")}
            return self.spark.read.schema(T.StructType([*TABLES[name].fields, T.StructField("shard", T.IntegerType())])).parquet(to)

        stored, tables, in_shards, in_order = {}, index.tables, index.shards == shards, ()
        if index.derive:
            stored["records"] = put("records", index.source, False)
            if stored["records"].groupBy("id").count().where("count > 1").isEmpty():
                tables, in_shards, in_order = index.derive(stored["records"]), True, ("body_postings", "path_postings")
        # tables that do not need one another are written side by side
        with _open_files(self.spark, shards), ThreadPoolExecutor(4) as pool:
            independent = [n for n in ("body_postings", "vectors", "records", "path_postings") if n not in stored]
            stored.update(zip(independent, pool.map(lambda n: put(n, tables[n], in_shards, n in in_order), independent), strict=True))
            parts = ("body", "path")
            list(pool.map(lambda n: put(f"{n}_lengths", lexical.lengths_of(stored["records"], stored[f"{n}_postings"]), False), parts))
        return places

    def save(self, index: Index, shards: int = SHARDS) -> None:
        """Replace what the store holds by ``index``."""
        if index.read_only:
            raise ReadOnlyError("a read-only index is not saved")
        if shards < 1:
            raise ValueError("shards must be positive")
        version = self.manifest()["version"] + 1 if self.exists() else 1
        self._commit({"version": version, "shards": shards, "tables": self._put(index, version, shards)})

    def load(self, read_only: bool = True) -> Index:
        """The current version, lazily: a query reads the columns and row groups it needs."""
        return self._open(self.manifest(), read_only)

    def _open(self, about: dict, read_only: bool = True) -> Index:
        layers, tables = _layers(about), {}
        hint = F.broadcast if sum(x["n_gone"] for x in layers[1:]) <= GONE else lambda df: df
        for name, schema in TABLES.items():
            parts = []
            for i, layer in enumerate(layers):
                folders = [f"{self.root}/{f}" for f in layer["tables"].get(name, {}).values()]
                if folders:
                    df = self.spark.read.schema(schema).parquet(*folders)
                    over = [f"{self.root}/{x['gone']}" for x in layers[i + 1 :]]
                    parts.append(df.join(hint(self.spark.read.schema("id long").parquet(*over)), "id", "left_anti").select(df.columns) if over else df)
            tables[name] = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)
        return Index(tables, read_only)

    def apply(self, removed: DataFrame | None, added: Index | None) -> int:
        """Drop the records with ids of ``removed``, add those of ``added``; the new version.

        An added id replaces the record that has it. Only what is new is written, and from time to
        time the shards that changed.
        """
        about = self.manifest()
        shards, version = about["shards"], about["version"] + 1
        layer = {"tables": self._put(added, version, shards) if added else {}, "gone": f"v{version}-{uuid.uuid4().hex[:8]}/gone"}
        new = [f"{self.root}/{f}" for f in layer["tables"].get("records", {}).values()]
        gone = [d.select(F.col("id").cast("long")) for d in (removed, self.spark.read.schema(RECORD).parquet(*new) if new else None) if d is not None]
        if not gone:
            return about["version"]
        reduce(DataFrame.unionByName, gone).distinct().write.parquet(f"{self.root}/{layer['gone']}")
        layer["n_gone"] = self.spark.read.schema("id long").parquet(f"{self.root}/{layer['gone']}").count()
        if not layer["n_gone"]:
            self._fs.delete(self._path(f"{self.root}/{layer['gone']}").getParent(), True)
            return about["version"]
        about = {**about, "version": version, "layers": [*about.get("layers", []), layer]}
        if len(about["layers"]) > LAYERS or sum(x["n_gone"] for x in about["layers"]) > GONE:
            about = self._merged(about)
        self._commit(about)
        for place in _folders({"tables": {}, "layers": [layer]}) - _folders(about):
            self._fs.delete(self._path(f"{self.root}/{place}"), True)
        return version

    def _merged(self, about: dict) -> dict:
        """``about`` without layers: the shards that they touch are written anew."""
        shards, layers = about["shards"], about["layers"]
        gone = self.spark.read.schema("id long").parquet(*(f"{self.root}/{x['gone']}" for x in layers))
        touched = {str(r[0]) for r in gone.select(shard_of("id", shards)).distinct().collect()}  # at most `shards`
        part = lambda tables: {n: {s: f for s, f in places.items() if s in touched} for n, places in tables.items()}
        now = self._open({"tables": part(about["tables"]), "layers": layers}).tables
        few = sum(x["n_gone"] for x in layers) <= GONE  # then rows stay where they are, in files of their shard
        fresh = self._put(Index({n: t.withColumn("shard", shard_of("id", shards)) for n, t in now.items()}, shards=shards if few else None), about["version"], shards)
        tables = {n: {**{s: f for s, f in places.items() if s not in touched}, **fresh[n]} for n, places in about["tables"].items()}
        return {**about, "tables": tables, "layers": []}

    def late(self) -> list[str]:
        """Paths that the next burst deletes; kept here, so that a restart does not lose them."""
        return json.loads(self._read("late.json")) if self._fs.exists(self._path(f"{self.root}/late.json")) else []

    def put_late(self, paths: list[str]) -> None:
        self._write("late.json", json.dumps(paths))

    def add(self, records: DataFrame, embedder: Embedder | None = None) -> int:
        return self.apply(None, build(records, embedder))

    def remove(self, ids: DataFrame) -> int:
        return self.apply(ids, None)
