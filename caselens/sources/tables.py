"""Stored tables: writing derived rows and listing what a case holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import delete_folder, escape_partition


def _replace_sources(df: DataFrame, path: str, sources: DataFrame | None) -> int:
    """Overwrite only the partitions of the sources in ``df``; return the rows written.

    ``sources`` (source_id) lists what was parsed: one that gave no row loses its old rows.
    """
    from pyspark.sql import Observation
    seen = Observation()
    (df.observe(seen, F.count(F.lit(1)).alias("rows"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("source_id").parquet(path))
    if sources is not None:
        spark = df.sparkSession
        written = spark.read.schema(df.schema).parquet(path).select("source_id").distinct()
        parsed = df.select("source_id").distinct()
        stale = sources.select("source_id").distinct().join(written, "source_id", "left_semi").join(
            parsed, "source_id", "left_anti")
        # One row per source that has become empty.
        for row in stale.toLocalIterator():
            delete_folder(spark, f"{path}/source_id={escape_partition(row['source_id'])}")
    return seen.get["rows"]


def read_stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table with its declared types: ids such as 007 stay texts."""
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def write_events(events: DataFrame, path: str, sources: DataFrame | None = None) -> int:
    """Write events by source; parsing a source again replaces its rows.

    Input splits never mix many sources, so the rows are written where they were parsed:
    a source of any size is written by many tasks and nothing is shuffled. ``sources``
    names the parsed sources, also those without events.
    """
    return _replace_sources(events, path, sources)


def write_entities(entities: DataFrame, path: str, sources: DataFrame | None = None) -> int:
    return _replace_sources(entities, path, sources)


def list_sources(sources: DataFrame, reports: DataFrame) -> DataFrame:
    """Every source with its latest parse report (``reports`` has ``run_ts``)."""
    columns = [c for c in reports.columns if c not in ("source_id", "run_ts")]
    latest = reports.groupBy("source_id").agg(
        F.max_by(F.struct(*columns), "run_ts").alias("parse_report"))
    return sources.join(latest, "source_id", "left")


def case_overview(cases: DataFrame, sources: DataFrame) -> DataFrame:
    """Cases with their number of sources, newest first."""
    counts = sources.groupBy("case_id").agg(F.count(F.lit(1)).alias("source_count"))
    return (cases.join(counts, "case_id", "left")
            .withColumn("source_count", F.coalesce("source_count", F.lit(0)))
            .orderBy(F.desc("created_at"), "case_id"))
