"""Exact duplicates by sorting contents.

Sampled splitters cut the order of normalised contents into ranges. A row goes to the range
of its content, an external sort inside the ranges places equal contents side by side, and a
row belongs to the group of its neighbour when their whole contents are equal. Everything is
a DataFrame operation: one exchange moves the contents, one sort orders them.

The order is (first bytes of the content, its SHA-256, a hash of the id), so a splitter is
short however long the contents are, and a splitter may fall inside a group of copies: a group
that holds a third of all rows lies in as many ranges as its size asks for. Such a group meets
again as one row for each range, with its contents compared as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .storage import stored

HEAD_BYTES = 32
RANGES_PER_PARTITION, MOST_RANGES = 4, 1 << 16
SAMPLES_PER_RANGE, MOST_SAMPLES = 16, 1 << 17
# Content and id part of a key, each of fixed width in hexadecimal digits.
_CONTENT, _ID = 2 * HEAD_BYTES + 64, 16
_SPAN_ROW_BYTES = 400


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _key(content: Column, digest: Column, doc_id: Column) -> Column:
    """A string that sorts by the first bytes of the content, then its digest, then the id's
    hash. Short contents are filled up with zero bytes; the digest tells them apart."""
    head = F.rpad(F.hex(F.substring(F.encode(content, "utf-8"), 1, HEAD_BYTES)), 2 * HEAD_BYTES, "0")
    return F.concat(F.lower(head), digest, F.lpad(F.lower(F.hex(F.xxhash64(doc_id))), _ID, "0"))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("content"))
    rows = rows.withColumn("digest", F.sha2(F.col("content"), 256))
    return rows.withColumn("key", _key(F.col("content"), F.col("digest"), F.col("doc_id")))


def sampled_splitters(docs: DataFrame, doc_id: str, text: str, ranges: int) -> list[str]:
    """At most ``ranges - 1`` keys that cut a bounded sample of rows into equal parts."""
    rows = docs.count()
    wanted = min(SAMPLES_PER_RANGE * ranges, MOST_SAMPLES)
    share = min(1.0, wanted / max(rows, 1))
    sample = sorted(r["key"] for r in _keyed(
        docs.sample(fraction=share, seed=17), doc_id, text).select("key").collect())
    cuts = {sample[len(sample) * i // ranges] for i in range(1, ranges)} if sample else set()
    return sorted(cuts)


def _at(splitters: Column, place: Column) -> Column:
    return F.coalesce(F.get(splitters, place), F.lit(""))


def _range_of(key: Column, splitters: Column, count: int) -> Column:
    """How many splitters are not above the key, by binary search."""
    steps = [1 << i for i in reversed(range(count.bit_length()))]
    if not steps:
        return F.lit(0)
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda low, step: F.when((low + step <= count) & (_at(splitters, low + step - 1) <= key),
                                 low + step).otherwise(low))


def _ranged(rows: DataFrame, splitters: list[str]) -> DataFrame:
    """Adds ``range`` and ``cut``: whether a splitter falls into the row's group of copies."""
    # One constant array of strings; a list of single literals would swell the plan.
    table = F.split(F.lit(",".join(splitters)), ",")
    found = rows.withColumn("range", _range_of(F.col("key"), table, len(splitters)))
    same = lambda place: (F.substring(_at(table, place), 1, _CONTENT)
                          == F.substring("key", 1, _CONTENT))
    return found.withColumn("cut", (same(F.col("range") - 1) & (F.col("range") > 0))
                            | same(F.col("range")))


def _ranges(spark: SparkSession) -> int:
    return min(MOST_RANGES, RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))


def find_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of rows whose normalised texts are equal; of each the smallest id stays.

    Returns one row per input row: doc_id, keep_id (the smallest id of the group), group_size,
    kept, text_sha256 (of the normalised text in UTF-8). Null and empty texts are equal, and so
    are texts of white space alone, which are one space. A null id is never the smallest; a
    group without any id keeps one row and has a null keep_id. Of rows that repeat the smallest
    id one stays; rows that repeat one id and one text lie in one range and are sorted on disk
    if need be. Other columns are not read. An empty table gives no rows.
    """
    splitters = sampled_splitters(docs, doc_id, text, _ranges(docs.sparkSession))
    rows = _ranged(_keyed(docs, doc_id, text), splitters).drop("key").repartition("range")
    # Sorted by range and content; neighbours with equal contents form a run.
    run = Window.partitionBy("range", "content")
    order = run.orderBy(F.col("doc_id").asc_nulls_last())
    runs = rows.select(
        "doc_id", "digest", "cut", F.row_number().over(order).alias("place"),
        F.first("doc_id").over(order).alias("keep_id"), F.count(F.lit(1)).over(run).alias("size"),
        F.when(F.col("cut") & (F.row_number().over(order) == 1), F.col("content")).alias("content"))
    runs = stored(runs, "runs")
    # Runs of one group in neighbouring ranges: one row a run, compared by their contents.
    spans = stored(runs.where("cut and place = 1").groupBy("digest").agg(
        F.min("keep_id").alias("span_id"), F.sum("size").alias("span_size"),
        F.min("content").alias("_p"), F.max("content").alias("_q")).select(
        "digest", "span_id", F.when(F.col("_p") == F.col("_q"), F.col("span_size")).otherwise(
            F.raise_error(F.lit("two contents share a digest")).cast("bigint")).alias("span_size")),
        "spans")
    # At most one row for each splitter, and measured.
    joined = runs.join(broadcast_if_small(
        spans.withColumnRenamed("digest", "_digest"), _SPAN_ROW_BYTES),
        F.col("cut") & (F.col("digest") == F.col("_digest")), "left")
    keep = F.when(F.col("cut"), F.col("span_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id", keep.alias("keep_id"),
        F.coalesce("span_size", "size").alias("group_size"),
        ((F.col("place") == 1) & F.col("doc_id").eqNullSafe(keep)).alias("kept"),
        F.col("digest").alias("text_sha256"))
