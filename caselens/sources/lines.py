"""Text files as numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import is_blank
from ..session import broadcast_if_small, cut_lineage, new_folder

# One row of the split table: path, offset, first row id, lines before.
_SPLIT_ROW_BYTES = 400


def _snapshot(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The lines of ``paths``, read once: path, start of the split, row id, bytes.

    Row ids grow by one inside a split. They are stored with the lines, so later readings do
    not depend on how files would be split then, nor on files that change meanwhile.
    """
    folder = new_folder(spark, "lines")
    spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"),
        F.col("value").cast("binary").alias("_bytes")).write.parquet(folder)
    return spark.read.parquet(folder)


def _refuse_repeated(sources: DataFrame) -> None:
    again = sources.groupBy(plain_path("path").alias("path")).count().where("count > 1").first()
    if again:
        raise ValueError(f"{again['path']} is named by {again['count']} sources")


def read_log_lines(spark: SparkSession, paths: list[str] | str,
                   sources: DataFrame | None = None) -> DataFrame:
    """Every physical line of ``paths``: path, line_no (from 1), raw.

    The files are read once, into a columnar copy in the shared folder. A line number is the
    row id minus the first id of its split plus the lines of the splits before it. Only the
    split table (one row per split) is aggregated; the text itself is not shuffled. ``sources``
    with columns ``path, source_id`` and optionally ``encoding`` names the files and says how
    to decode them; a file it does not name, or any file without it, has its path as source id
    and is read as UTF-8. A path that two sources name is an error.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if sources is not None:
        _refuse_repeated(sources)
    lines = _snapshot(spark, paths)
    per_split = lines.groupBy("path", "_start").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("path").orderBy("_start").rowsBetween(
        Window.unboundedPreceding, -1)
    splits = cut_lineage(per_split.select(
        "path", "_start", "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    numbered = lines.join(broadcast_if_small(splits, _SPLIT_ROW_BYTES), ["path", "_start"]).withColumn(
        "line_no", F.col("_row") - F.col("_first") + F.col("_before") + 1)
    if sources is None:
        return numbered.select(F.col("path").alias("source_id"), "line_no",
                               decode(F.col("_bytes"), "utf-8").alias("raw"))
    raw = decode(F.col("_bytes"), "utf-8")
    if "encoding" in sources.columns:
        declared = F.lower(F.coalesce("encoding", F.lit("utf-8")))
        # The source list is a small dimension table; its distinct encodings are a handful.
        for row in sources.select(declared.alias("e")).distinct().collect():
            raw = F.when(declared == row.e, decode(F.col("_bytes"), row.e)).otherwise(raw)
    # The source list is small next to the lines; a file that is not in it stays readable.
    named = sources.withColumn("_path", plain_path("path")).drop("path")
    return numbered.withColumn("_path", plain_path("path")).join(named, "_path", "left").select(
        F.coalesce("source_id", "path").alias("source_id"), "line_no", raw.alias("raw"))


def plain_path(path: str) -> Column:
    """One spelling for file:/x, file:///x and /x; other schemes as they are."""
    return F.regexp_replace(F.col(path), "^(?:file:)?/+", "/")


def unregistered_files(spark: SparkSession, paths: list[str] | str, sources: DataFrame) -> DataFrame:
    """Files under ``paths`` that no source names: their lines have the path as source id."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select(
        "path", "length")
    return files.withColumn("_path", plain_path("path")).join(
        sources.select(plain_path("path").alias("_path")), "_path", "left_anti").drop("_path")


def decode(data: Column, encoding: str) -> Column:
    """Bytes of one line as text; malformed bytes become U+FFFD.

    Lines are cut at newline bytes before decoding, so encodings in which a newline byte
    can be half of a character are refused.
    """
    name = encoding.strip().lower().replace("_", "-")
    if name.startswith(("utf-16", "utf-32", "utf16", "utf32", "ucs")):
        raise ValueError(f"{encoding}: lines cannot be cut before decoding")
    if name in ("utf-8", "utf8"):
        return F.make_valid_utf8(data.cast("string"))
    return F.decode(data, "GBK" if name in ("gbk", "gb2312", "cp936") else encoding)


def view_lines(lines: DataFrame, source_id: str, offset: int = 0, limit: int = 200) -> DataFrame:
    """Lines ``offset + 1 … offset + limit`` of one source, blank and bad ones included."""
    return (lines.where((F.col("source_id") == source_id)
                        & F.col("line_no").between(offset + 1, offset + limit))
            .orderBy("line_no"))


def tail_lines(lines: DataFrame, n: int, q: str | None = None) -> DataFrame:
    """The last ``n`` lines of one file in file order, then the keyword filter on them."""
    tail = lines.orderBy(F.desc("line_no")).limit(n)
    if q and q.strip():
        tail = tail.where(F.lower("raw").contains(q.strip().lower()))
    return tail.orderBy("line_no")


def non_blank(lines: DataFrame) -> DataFrame:
    return lines.where(~is_blank(F.col("raw")))
