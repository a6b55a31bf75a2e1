"""Row shapes of the engine, in one place."""

from __future__ import annotations

from pyspark.sql import types as T

_string = lambda *names: [T.StructField(n, T.StringType(), False) for n in names]

PASSAGE = T.StructType(_string("source", "location", "title", "text"))
RECORD = T.StructType([T.StructField("id", T.LongType(), False), *_string("source", "location", "title", "language", "text")])
POSTING = T.StructType([T.StructField("term", T.StringType()), T.StructField("id", T.LongType()), T.StructField("tf", T.LongType()), T.StructField("dl", T.LongType())])
LENGTHS = T.StructType([T.StructField("id", T.LongType()), T.StructField("dl", T.LongType())])
VECTOR = T.StructType([T.StructField("id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
CHANGE = T.StructType([T.StructField("seq", T.LongType()), T.StructField("path", T.StringType()), T.StructField("kind", T.StringType())])
UPSERT, DELETE = "Upsert", "Delete"
