"""Joining per-group facts back to rows when one group may hold a third of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of one group that a single task may receive; larger groups are salted.
GROUP_ROWS_PER_TASK = 4_000_000


def join_group_facts(rows: DataFrame, facts: DataFrame, keys: list[str], size: str,
                     spread: list[str], rows_per_task: int = GROUP_ROWS_PER_TASK) -> DataFrame:
    """Inner join ``rows`` with ``facts`` (one row per group) on ``keys``.

    ``size`` is the column of ``facts`` that says how many of ``rows`` the group has.
    Groups above ``rows_per_task`` are cut into that many salts: their rows by the hash
    of ``spread``, their fact row by repetition. The salt table is broadcast; it has at
    most total rows / ``rows_per_task`` entries, so its size is bounded by construction.
    """
    salts = F.ceil(F.col(size) / F.lit(rows_per_task)).cast("int")
    hot = F.broadcast(
        facts.where(F.col(size) > rows_per_task).select(*keys, salts.alias("_salts")))
    salted_rows = (
        rows.join(hot, keys, "left")
        .withColumn("_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(*spread), F.col("_salts")).cast("int")))
        .drop("_salts"))
    salted_facts = facts.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return salted_rows.join(salted_facts, [*keys, "_salt"]).drop("_salt")


def not_null(columns: list[str]) -> Column:
    cond = F.lit(True)
    for name in columns:
        cond = cond & F.col(name).isNotNull()
    return cond
