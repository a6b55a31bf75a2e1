"""Keyed change feeds: coalesce, upsert, subtree delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DELETE


def coalesce_changes(changes: DataFrame, key: str = "path", order: list[str] | None = None) -> DataFrame:
    """The last change of each key, by ``order`` (seq): a partial maximum, then one shuffle."""
    others = [c for c in changes.columns if c != key]
    last = F.max_by(F.struct(*others), F.struct(*(order or ["seq"])))
    return changes.groupBy(key).agg(last.alias("last")).select(key, *[F.col(f"last.{c}").alias(c) for c in others])


def upsert(base: DataFrame, changed: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """``base`` without the keys of ``changed``, and the rows of ``fresh``."""
    return base.join(changed.select(key).distinct(), key, "left_anti").select(base.columns).unionByName(fresh.select(base.columns))


def ancestors(path: Column) -> Column:
    """The path itself and every directory above it: a/b/c gives a/b/c, a/b and a."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def without_subtrees(base: DataFrame, deleted: DataFrame, path: str = "path", ignore_case: bool = False) -> DataFrame:
    """``base`` without the deleted paths and everything below them.

    A row meets a deletion through an equal ancestor, so this is a hash anti-join on distinct
    paths and not a comparison of every row with every deletion.
    """
    fold = F.lower if ignore_case else (lambda c: c)
    gone = deleted.select(fold(F.rtrim(F.col(path), F.lit("/"))).alias("gone")).distinct()
    paths = base.select(F.col(path)).distinct()
    below = paths.select(path, F.explode(ancestors(fold(F.col(path)))).alias("gone")).join(gone, "gone", "left_semi").select(path).distinct()
    return base.join(below, path, "left_anti").select(base.columns)


def split_changes(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(upserts, deletes) of a coalesced feed."""
    return changes.where(F.col("kind") != DELETE), changes.where(F.col("kind") == DELETE)
