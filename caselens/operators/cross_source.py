"""Entities that several sources have in common."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cross_source_entities(entities: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Global entities of at least two sources, one row per entity and source.

    Occurrences are reduced to one row per entity and source before anything else; a window
    over an entity then has at most as many rows as there are sources.
    """
    scoped = entities.where(F.col("qualifier") == "global")
    if sources is not None:
        scoped = scoped.join(sources.select("source_id"), "source_id", "left_semi")
    per_source = scoped.groupBy("canonical_key", "entity_type", "source_id").agg(
        F.count(F.lit(1)).alias("occurrences"), F.min("line_no").alias("line_no"),
        F.min("ts_utc").alias("first_ts"))
    over_key = Window.partitionBy("canonical_key")
    # An entity key has one type, so the rows of a key are its sources.
    return per_source.withColumn("source_count", F.count(F.lit(1)).over(over_key)).where(
        F.col("source_count") >= 2)
