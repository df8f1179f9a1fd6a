"""Sharding along a Hilbert curve.

Metadata dimensions (source, language, text length) are quantised to the same number of
bits, rows are sorted by their index on the Hilbert curve through that grid, and the order is
cut into runs. Neighbours on the curve are near in every dimension, so a file of a run has
narrow ranges in all of them and filters on any dimension skip files.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

BITS = 8


def hilbert_index(point: Sequence[np.ndarray], bits: int = BITS) -> np.ndarray:
    """Indexes on the Hilbert curve of points with ``bits`` bits in each dimension.

    From the highest bit down, each dimension inverts the lower bits of the first one or
    exchanges them with its own; the Gray code of the result, read across dimensions from
    the highest bit, is the index.
    """
    x = [np.asarray(d, np.int64).copy() for d in point]
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(len(x)):
            inverts = (x[i] >> bit) & 1 == 1
            swap = np.where(inverts, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inverts, low, swap)
            x[i] ^= swap
    x = list(np.bitwise_xor.accumulate(x))
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for d in x:
            index = index << 1 | ((d ^ turn) >> bit) & 1
    return index


def _hilbert(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index([a.to_numpy(), b.to_numpy(), c.to_numpy()]))


def _quantised(docs: DataFrame) -> list[Column]:
    """Dimensions on 0..255: names by hash, lengths by logarithm; a null is a value too."""
    name = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(1 << BITS))
    size = F.least(F.lit((1 << BITS) - 1), F.floor(F.log2(F.octet_length(
        F.coalesce("text", F.lit(""))) + 1) * 10))
    return [name("source"), name("lang"), size]


def assign_shards(docs: DataFrame, shards: int = 24, keep: Sequence[str] = ("doc_id",)
                  ) -> DataFrame:
    """``keep`` columns plus size, text_crc32, hilbert, shard and slot for every row.

    The law is ``rows``: runs of the curve order whose counts differ by one at most. Equal
    texts of equal metadata have one index and stand together, then the id decides; rows
    equal in all of this are interchangeable. Null text counts as empty, null ids sort
    first, and fewer rows than shards leave shards empty. Only lengths and hashes are
    sorted, never texts; an order position comes from the number of rows in earlier ranges.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(*keep, (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"),
                       F.pandas_udf(_hilbert, "long")(*_quantised(docs)).alias("hilbert"))
    order = ["hilbert", "text_crc32", *keep]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = cut_lineage(slim.repartitionByRange(ranges, *order).sortWithinPartitions(
        *order).withColumn("_at", F.monotonically_increasing_id()))
    # The id counts rows inside a range in its low 33 bits; ranges are few.
    counts = {r["p"]: r["n"] for r in ranged.groupBy(
        F.shiftright("_at", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    before, running = [], 0
    for p in sorted(counts):
        before.append((p, running))
        running += counts[p]
    table = F.broadcast(spark.createDataFrame(before, "_p long, _before long"))
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    rows = ranged.join(table, F.shiftright("_at", 33) == F.col("_p")).withColumn("_rank", rank)
    shard = F.expr(f"_rank * {shards} div {max(1, total)}")
    start = F.expr(f"(_shard * {total} + {shards - 1}) div {shards}")
    return rows.withColumn("_shard", shard).select(
        *keep, "size", "text_crc32", "hilbert", F.col("_shard").cast("int").alias("shard"),
        (F.col("_rank") - start).cast("long").alias("slot"))
