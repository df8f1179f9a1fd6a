"""Files as evidence: hashes, duplicates, verification and heads for format detection."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import plain_path

_CHUNK = 8 * 1024 * 1024
HEAD_BYTES = 512 * 1024


def _open(path: str):
    """A readable binary stream for a path as Spark prints it."""
    from pyarrow import fs
    if path.startswith("file:"):
        path = "file://" + "/" + path[len("file:"):].lstrip("/")
    elif "://" not in path:
        path = "file://" + path
    filesystem, inside = fs.FileSystem.from_uri(path)
    return filesystem.open_input_stream(inside, compression=None)


def _listing(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Path and length only: the content column is pruned, nothing is read."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .load(paths).select("path", "length"))


def file_inventory(spark: SparkSession, paths: list[str] | str,
                   only: DataFrame | None = None) -> DataFrame:
    """path, length, sha256 per file; files are hashed in parallel, each as a stream.

    ``only`` (path) names the files to hash among those found; the others are not opened.
    """
    def hashes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            digests = []
            for path in frame["path"]:
                digest = hashlib.sha256()
                with _open(path) as stream:
                    while chunk := stream.read(_CHUNK):
                        digest.update(chunk)
                digests.append(digest.hexdigest())
            yield frame.assign(sha256=digests)

    listed = _listing(spark, paths)
    if only is not None:
        listed = listed.withColumn("_path", plain_path("path")).join(
            only.select(plain_path("path").alias("_path")).distinct(), "_path", "left_semi").drop("_path")
    return listed.mapInPandas(hashes, "path string, length long, sha256 string")


def distinct_contents(inventory: DataFrame) -> DataFrame:
    """One row per content: the smallest path keeps it, the number of copies is counted."""
    return inventory.groupBy("sha256").agg(
        F.min("path").alias("path"), F.min("length").alias("length"),
        F.count(F.lit(1)).alias("copies"))


def verify_files(inventory: DataFrame, registry: DataFrame) -> DataFrame:
    """``registry`` (path, sha256) against what is there: ok, mismatch or missing."""
    found = inventory.select("path", F.col("sha256").alias("actual"))
    return registry.join(found, "path", "left").withColumn(
        "state", F.when(F.col("actual").isNull(), "missing")
        .when(F.col("actual") == F.col("sha256"), "ok").otherwise("mismatch"))


def sample_heads(spark: SparkSession, paths: list[str] | str, sample_lines: int = 50) -> DataFrame:
    """The first non-blank lines of every file, from its first 512 KB only."""
    def heads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                with _open(path) as stream:
                    text = stream.read(HEAD_BYTES).decode("utf-8", errors="replace")
                kept = [line for line in text.splitlines() if line.strip()][:sample_lines]
                yield pd.DataFrame({"source_id": path, "line_no": range(1, len(kept) + 1),
                                    "raw": kept})

    return _listing(spark, paths).mapInPandas(
        heads, "source_id string, line_no long, raw string")
