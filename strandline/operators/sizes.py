"""Broadcasts behind a check of size, and batches of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is.

    The count stops at one row beyond the limit.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def arrow_bytes(spark: SparkSession, most: int = 2 << 20) -> None:
    """Bound the bytes of an Arrow batch, so that a batch of long texts fits in a Python worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, "64m"))
    if now > most:
        spark.conf.set(key, str(most))
