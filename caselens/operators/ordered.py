"""Ordered state inside one source without putting the source into one task.

A running value over a whole file ("the last header line above", "the previous
anchor") is computed per block of lines; the state handed from block to block is a
window over one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_LIMIT_BYTES, cut_lineage

BLOCK_LINES = 65_536
SPARSE_BLOCK_LINES = 16_384


def carry_forward(df: DataFrame, part: list[str], order: str, value: Column, out: str,
                  strict: bool = False, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Add ``out``: the last non-null ``value`` at or before each row.

    ``order`` is an integer line number that is unique within ``part``; ``strict`` looks
    only at rows before the current one.
    """
    keys = [*part, "_block"]
    blocked = (df.withColumn("_block", F.floor(F.col(order) / F.lit(block_lines)))
               .withColumn("_value", value))
    tails = blocked.groupBy(*keys).agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_tail"))
    earlier = Window.partitionBy(*part).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    carried = tails.select(*keys, F.last("_tail", ignorenulls=True).over(earlier).alias("_carry"))
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1 if strict else Window.currentRow)
    return (blocked.join(carried, keys)
            .withColumn(out, F.coalesce(
                F.last("_value", ignorenulls=True).over(inside), F.col("_carry")))
            .drop("_block", "_value", "_carry"))


def carry_sparse(df: DataFrame, part: list[str], order: str, value: Column, out: str,
                 block_lines: int = SPARSE_BLOCK_LINES) -> DataFrame:
    """Add ``out`` as ``carry_forward`` does, for values that few rows have, without moving rows.

    A first pass reduces the rows to one per block: its values with their places, and the last
    value of earlier blocks. That table meets the rows by broadcast while its measured bytes
    allow it, and the rows stay where they were read.
    """
    keys = [*part, "_block"]
    blocked = df.withColumn("_block", F.floor(F.col(order) / F.lit(block_lines)))
    marks = blocked.select(*keys, F.col(order).alias("_at"), value.alias("_value")).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("_value").isNotNull(), F.struct(
            F.col("_at").alias("at"), F.col("_value").alias("value"))))).alias("_marks"))
    earlier = Window.partitionBy(*part).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.size("_marks") > 0, F.element_at("_marks", -1)["value"])
    marks = cut_lineage(marks.withColumn("_carry", F.last(last, ignorenulls=True).over(earlier)))
    size = marks.agg(F.sum(F.length(F.to_json(F.struct(*marks.columns))))).first()[0] or 0
    if size <= BROADCAST_LIMIT_BYTES:
        marks = F.broadcast(marks)
    above = F.filter("_marks", lambda m: m["at"] <= F.col(order))
    return blocked.join(marks, keys).withColumn(out, F.when(
        F.size("_marks") == 0, F.col("_carry")).otherwise(F.coalesce(
            F.get(above, F.size(above) - 1)["value"], F.col("_carry")))).drop("_block", "_marks", "_carry")
