"""Search for people and programs: checks, rendering, requests."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clamp, snippet
from ..operators.fusion import hybrid_top
from ..operators.vectors import Embedder, HashingEmbedder
from ..shipping import ship

TOP, TOP_MOST = 5, 50
SOURCES = ("file", "git")


def query_rows(spark: SparkSession, texts: list[str]) -> DataFrame:
    """A query table (query_id, text) of some texts; blank ones are refused."""
    if any(not t or not t.strip() for t in texts):
        raise ValueError("a query must not be blank")
    return spark.createDataFrame(pa.table({"query_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}))


class SearchService:
    """Hybrid search over an index; results are DataFrames or rendered text."""

    def __init__(self, spark: SparkSession, index, embedder: Embedder | None = None):
        ship(spark)
        self.spark, self.index, self.embedder = spark, index, embedder or HashingEmbedder()

    def search_many(self, queries: DataFrame, top: int = TOP, language: str | None = None, source: str | None = None) -> DataFrame:
        """``queries``: query_id, text, and vector if it is known."""
        return hybrid_top(queries, self.index, top, language, source, self.embedder)

    def search(self, query: str, top: int = TOP, language: str | None = None, source: str | None = None) -> DataFrame:
        if source is not None and source not in SOURCES:
            raise ValueError(f"source must be one of {', '.join(SOURCES)}")
        # one query is one partition of the last window, which leaves it in the order of ranks
        return self.search_many(query_rows(self.spark, [query]), top, language, source)

    def respond(self, request: str) -> str:
        """One JSON line in, one out; a service's ``top`` is held between 1 and TOP_MOST."""
        try:
            asked = json.loads(request)
            if asked.get("command") == "stop":
                return json.dumps({"error": None, "stopped": True, "results": []})
            top = clamp(int(asked.get("top", TOP)), 1, TOP_MOST)
            if asked.get("command") == "console":  # the lines that a search without a service prints
                shown = self.console(asked.get("query") or "", top=top, language=asked.get("language"), source=asked.get("source"))
                return json.dumps({"error": None, "stopped": False, "console": shown})
            found = self.search(asked.get("query") or "", top, asked.get("language"), asked.get("source")).select(result_json().alias("r")).collect()
            return json.dumps({"error": None, "stopped": False, "results": [json.loads(r["r"]) for r in found]})
        except (ValueError, TypeError, AttributeError) as e:
            return json.dumps({"error": str(e), "stopped": False, "results": []})

    def console(self, query: str, **options) -> str:
        lines = [r["line"] for r in self.search(query, **options).select(console_line().alias("line")).collect()]
        return "\n".join(lines) if lines else "No matches."

    def tool_text(self, query: str, top: int = TOP) -> str:
        """The text that the search tool of an agent gets."""
        lines = [r["line"] for r in self.search(query, clamp(top, 1, TOP_MOST)).select(tool_line().alias("line")).collect()]
        return "\n".join(lines) if lines else "No matches."


def result_json():
    return F.to_json(F.struct("score", "source", "location", "title", "language", "text"))


def _head():
    score = F.format_string("%6.3f", F.col("score").cast("double"))
    return F.concat(score, F.lit("  ["), F.col("language"), F.lit("]  "), F.col("source"), F.lit(":"), F.col("location"))


def console_line():
    """Score, language and place; below them title and text, at most 90 characters each."""
    return F.concat(_head(), F.lit("\n        "), snippet("title", 90), F.lit("\n        "), snippet("text", 90))


def tool_line():
    """As on the console, with 200 characters of text, and no line for a blank title."""
    title = snippet("title", 90)
    return F.concat(_head(), F.when(title != "", F.concat(F.lit("\n    "), title)).otherwise(F.lit("")), F.lit("\n    "), snippet("text", 200))
