"""A live index: a keyed change feed applied in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import location_path
from ..operators.changes import coalesce_changes, split_changes, without_subtrees
from ..operators.vectors import Embedder
from ..plans.snapshot import Index, Store, build, to_records
from ..schemas import CHANGE, DELETE
from ..sources.files import in_skipped

DEBOUNCE_MS = 500


class LiveIndex:
    """Keeps a store in step with changes (seq, path, kind).

    ``passages_of`` gives the passages now at some paths, from a DataFrame with column path; a
    path that has none is removed. ``ignored`` may give, after a batch, the new paths that should
    not have been indexed; the store keeps them, and they are deleted with the next batch. The
    state is the store itself: a record's path is in its location.
    """

    def __init__(self, store: Store, passages_of: Callable[[DataFrame], DataFrame], embedder: Embedder | None = None, language=None, ignored: Callable[[DataFrame], DataFrame] | None = None):
        self.store, self.passages_of, self.embedder, self.language, self.ignored = store, passages_of, embedder, language, ignored

    def index(self) -> Index:
        """The version of now; a running query keeps the one it opened."""
        return self.store.load()

    def file_count(self) -> int:
        return self.index().records.where("source = 'file'").agg(F.count_distinct(location_path("location"))).first()[0]

    def apply(self, changes: DataFrame, batch: int | None = None) -> int:
        """Apply one burst: the last change of a path wins; a deleted path takes all below it."""
        changes = changes.select("seq", "path", "kind").where(~in_skipped(F.col("path")))
        late = self.store.late()
        if late:
            changes = changes.sparkSession.createDataFrame([(-1, p, DELETE) for p in late], CHANGE).unionByName(changes)
        last = coalesce_changes(changes)
        upserts, deletes = split_changes(last)
        records = self.store.load().records.where("source = 'file'").select("id", location_path("location").alias("path"))
        kept = without_subtrees(records, deletes).join(upserts.select("path"), "path", "left_anti")
        removed = records.join(kept, "id", "left_anti").select("id")
        added = build(to_records(self.passages_of(upserts.select("path")), self.language), self.embedder)
        version = self.store.apply(removed, added)
        named = [r["path"] for r in self.ignored(upserts.select("path")).select("path").distinct().collect()] if self.ignored else []  # of a burst's paths
        if named != late:
            self.store.put_late(named)
        return version

    def start(self, changes: DataFrame, checkpoint: str, debounce_ms: int = DEBOUNCE_MS):
        """Run over a streaming change feed; each trigger is a burst. Offsets are checkpointed, so
        changes made while the service was down are applied when it is back; a burst that is
        applied twice gives the same index."""
        return changes.writeStream.foreachBatch(lambda df, batch: self.apply(df.persist(), batch) and df.unpersist()).option("checkpointLocation", checkpoint).trigger(processingTime=f"{debounce_ms} milliseconds").start()


def change_feed(spark, folder: str) -> DataFrame:
    """A streaming feed of JSON change lines that land in ``folder``."""
    return spark.readStream.schema(CHANGE).json(folder)
