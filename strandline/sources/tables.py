"""Tables as records of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def document_records(docs: DataFrame) -> DataFrame:
    """Records of a documents table: three in four as files of their source, the rest as commits."""
    is_file = F.col("doc_id") % 4 != 0
    n = F.col("doc_id").cast("string")
    location = F.when(is_file, F.concat("source", F.lit("/doc"), n, F.lit(".md:1-9"))).otherwise(F.substring(F.md5(n.cast("binary")), 1, 7))
    title = F.when(is_file, F.concat(F.lit("doc"), n, F.lit(".md"))).otherwise(F.concat(F.lit("Change "), n, F.lit("  ("), F.col("source"), F.lit(", 2024-01-01)")))
    return docs.select(F.col("doc_id").alias("id"), F.when(is_file, "file").otherwise("git").alias("source"), location.alias("location"), title.alias("title"), F.col("lang").alias("language"), "text")


def conversation_passages(turns: DataFrame) -> DataFrame:
    """One passage a turn, located by conversation and turn."""
    place = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    first = F.element_at(F.split("text", "\n", -1), 1)
    title = F.concat(first, F.lit("  ("), F.col("role"), F.lit(")"))
    return turns.select(F.lit("chat").alias("source"), place.alias("location"), title.alias("title"), "text")
