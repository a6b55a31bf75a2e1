"""A folder as a source of changes: it is listed again and again, and differences become a feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DELETE, UPSERT
from ..sources.files import listing


class FolderWatcher:
    """Writes what changed below ``root`` as JSON lines to ``feed``, which `change_feed` reads.

    A poll compares (path, time, length) of the files that an index takes with the listing of the
    poll before, which is a Parquet table in ``state``. New and changed files are upserts, missing
    ones deletes; a poll without differences writes nothing. Changes are written before their
    listing, so a poll that is cut off is repeated and none is lost. Without an earlier listing
    every file is an upsert. A file changed twice between polls is one change.
    """

    def __init__(self, spark: SparkSession, root: str, feed: str, state: str):
        self.spark, self.root, self.feed, self.state = spark, root, feed, state.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.state).getFileSystem(spark._jsc.hadoopConfiguration())
        for folder in (self.state, self.feed):
            self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(self._path(folder))

    def _last(self) -> int:
        """The number of the last whole listing, or 0."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.state))]
        whole = [n for n in names if n.startswith("listing-") and self._fs.exists(self._path(f"{self.state}/{n}/_SUCCESS"))]
        return max((int(n[8:]) for n in whole), default=0)

    def _put(self, number: int, now: DataFrame) -> None:
        now.write.mode("overwrite").parquet(f"{self.state}/listing-{number}")
        self._fs.delete(self._path(f"{self.state}/listing-{number - 1}"), True)

    def baseline(self) -> None:
        """Take what is there as known; for an index that is about to be built from all of it."""
        self._put(self._last() + 1, listing(self.spark, self.root))

    def poll(self) -> int:
        """The number of changes since the last poll, which are in the feed now."""
        last, now = self._last(), listing(self.spark, self.root).persist()
        try:
            then = self.spark.read.schema(now.schema).parquet(f"{self.state}/listing-{last}") if last else now.limit(0)
            both = now.withColumn("here", F.lit(True)).alias("n").join(then.alias("o"), "path", "full")
            same = F.col("n.modified").eqNullSafe(F.col("o.modified")) & F.col("n.length").eqNullSafe(F.col("o.length"))
            kind = F.when(F.col("here"), UPSERT).otherwise(DELETE)
            changes = both.where(~same).select(F.lit(last + 1).cast("long").alias("seq"), "path", kind.alias("kind")).persist()
            found = changes.count()
            if found:
                changes.coalesce(1).write.mode("append").json(self.feed)
                self._put(last + 1, now)
            changes.unpersist()
            return found
        finally:
            now.unpersist()
