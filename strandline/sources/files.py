"""Text files as passages: listing, filters and line ranges."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import passage_array, relative_path
from ..schemas import PASSAGE

# fixed values: extensions that are text, and directories that are skipped
EXTENSIONS = (
    "txt md markdown rst adoc org cs fs vb js mjs cjs ts tsx jsx py java kt go rs rb php swift scala dart "
    "c h cc cpp cxx hpp m mm json yml yaml toml ini cfg xml csproj props targets html htm css scss sql sh bash zsh ps1 psm1"
).split()
SKIPPED = ".git bin obj node_modules .vs .vscode .idea packages dist out target".split()


def is_text(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)).isin(EXTENSIONS)


def in_skipped(path: Column) -> Column:
    """Any directory on the way is one that is skipped, in any case."""
    parts = F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/", -1)
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(s) for s in SKIPPED]))


def should_index(path: Column) -> Column:
    return is_text(path) & ~in_skipped(path)


def git_listing(root: str) -> list[str] | None:
    """Tracked and untracked files that git does not ignore, relative; None outside a repository."""
    try:
        got = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True, check=False)
    except OSError:
        return None
    return None if got.returncode else [p for p in got.stdout.decode("utf-8", "replace").split("\0") if p]


def walked(root: str) -> list[str]:
    """All files below a local ``root``, skipped directories pruned, unreadable ones ignored."""
    out = []
    for at, directories, names in os.walk(root, onerror=lambda _: None):
        directories[:] = [d for d in directories if d.lower() not in SKIPPED]
        out += [os.path.relpath(os.path.join(at, n), root).replace(os.sep, "/") for n in names]
    return out


def git_ignored(root: str, paths: list[str]) -> set[str]:
    """Those of ``paths`` that git ignores, in one call; none without git or a repository."""
    if not paths:
        return set()
    try:
        got = subprocess.run(["git", "-C", root, "check-ignore", "-z", "--stdin"], input="\0".join(paths).encode(), capture_output=True, check=False)
    except OSError:
        return set()
    return set(got.stdout.decode("utf-8", "replace").split("\0")) - {""} if got.returncode in (0, 1) else set()


def split_files(files: DataFrame) -> DataFrame:
    """Passages of files (path, text): location path:start-end, title the file's name."""
    spans = files.select("path", F.explode(passage_array("text")).alias("p"))
    name = F.element_at(F.split("path", "/", -1), -1)
    location = F.concat("path", F.lit(":"), F.col("p.start").cast("string"), F.lit("-"), F.col("p.end").cast("string"))
    return spans.select(F.lit("file").alias("source"), location.alias("location"), name.alias("title"), F.col("p.text").alias("text"))


def _whole(spark: SparkSession, root: str) -> str:
    """``root`` in the file system's own form, which the paths of rows have."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def _read(spark: SparkSession, root: str, paths: list[str] | None) -> DataFrame:
    """(path, text) of files below root; with ``paths``, of those alone. Spark reads the bytes."""
    reader = spark.read.format("binaryFile").option("ignoreMissingFiles", "true")
    if paths is None:
        files = reader.option("recursiveFileLookup", "true").load(root)
    else:
        files = reader.load([f"{root}/{p}" for p in paths])
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    return files.select(relative_path("path", _whole(spark, root)).alias("path"), text.alias("text"))


def local_files(root: str) -> list[str]:
    """The files below a local ``root`` that an index takes, relative: git's listing in a work tree."""
    found = git_listing(root)
    if found is None:  # a work tree where all is ignored lists nothing, which is not the same
        found = walked(root)
    keep = [p for p in found if p.rpartition(".")[2].lower() in EXTENSIONS and "." in os.path.basename(p) and os.path.isfile(f"{root}/{p}")]
    return [p for p in keep if not any(s.lower() in SKIPPED for s in p.split("/")[:-1])]


def _local_root(root: str) -> str | None:
    """The real path of a folder that the driver itself lists; None for stores that Spark lists."""
    if "://" in root:
        return None
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    return os.path.realpath(root)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified, length) of the files that `scan_directory` reads; nothing is read here."""
    local = _local_root(root.rstrip("/"))
    if local is not None:
        rows = []
        for p in local_files(local):
            try:
                at = os.stat(f"{local}/{p}")
            except OSError:  # gone since it was listed
                continue
            rows.append((p, at.st_mtime_ns // 1000, at.st_size))
        return spark.createDataFrame(rows, "path string, modified long, length long")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(relative_path("path", _whole(spark, root)).alias("path"), F.unix_micros("modificationTime").alias("modified"), "length").where(should_index(F.col("path")))


def scan_directory(spark: SparkSession, root: str) -> DataFrame:
    """Passages of all text files below ``root``.

    In a local git work tree git lists the files; otherwise Spark lists them, which also reads
    stores that only Spark reaches. Extension and directory filters hold either way, so a batch
    and an incremental build agree.
    """
    root = root.rstrip("/")
    local = _local_root(root)
    if local is None:
        return split_files(_read(spark, root, None).where(should_index(F.col("path"))))
    keep = local_files(local)
    return split_files(_read(spark, local, keep)) if keep else spark.createDataFrame([], PASSAGE)


def scan_paths(spark: SparkSession, root: str, paths: list[str], check_ignored: bool = True) -> DataFrame:
    """Passages of some files, by path below ``root``; missing or unfit ones give none."""
    local = "://" not in root
    root = os.path.realpath(root) if local else root.rstrip("/")
    fit = [p for p in paths if "." in p and p.rpartition(".")[2].lower() in EXTENSIONS and not any(s.lower() in SKIPPED for s in p.split("/")[:-1])]
    if local:
        ignored = git_ignored(root, fit) if check_ignored else set()
        fit = [p for p in fit if p not in ignored and os.path.isfile(f"{root}/{p}")]
    return split_files(_read(spark, root, fit)) if fit else spark.createDataFrame([], PASSAGE)
