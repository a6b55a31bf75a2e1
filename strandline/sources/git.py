"""Commits as passages."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trimmed

# fixed values: what separates records and fields of the log
RECORD, FIELD = "\x1e", "\x1f"


def parse_log(raw: DataFrame, column: str = "value") -> DataFrame:
    """Passages of raw log text: records of short id, author, date, subject and body.

    Records with fewer than five fields are dropped. Text is the subject, and the body after an
    empty line if there is one; title is ``subject  (author, date)``.
    """
    record = F.explode(F.split(F.col(column), RECORD, -1)).alias("r")
    f = F.split(F.regexp_replace("r", r"^[\n\r]+|[\n\r]+$", ""), FIELD, -1)
    rows = raw.select(record).where(F.col("r") != "").select(f.alias("f")).where(F.size("f") >= 5)
    sha, author, date, subject = (F.col("f")[i] for i in range(4))
    body = trimmed(F.col("f")[4])
    text = F.when(body == "", subject).otherwise(F.concat(subject, F.lit("\n\n"), body))
    title = F.concat(subject, F.lit("  ("), author, F.lit(", "), date, F.lit(")"))
    return rows.select(F.lit("git").alias("source"), sha.alias("location"), title.alias("title"), text.alias("text"))


def scan_commits(spark: SparkSession, repository: str, most: int = 500) -> DataFrame:
    """Passages of the newest ``most`` commits that are not merges."""
    form = FIELD.join(["%h", "%an", "%ad", "%s", "%b"]) + RECORD
    got = subprocess.run(["git", "-C", repository, "log", "--no-merges", f"--max-count={most}", "--date=short", f"--pretty=format:{form}"], capture_output=True, check=False)
    if got.returncode:
        raise RuntimeError(got.stderr.decode("utf-8", "replace").strip())
    records = [(r,) for r in got.stdout.decode("utf-8", "replace").split(RECORD)]
    return parse_log(spark.createDataFrame(records, "value string"))
