"""Registered queries and, next to each, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The driver's events as an event table: one source per event type."""
    return table(spark, folder, "events").select(
        F.col("event_type").alias("source_id"), (F.col("event_id") + 1).alias("line_no"),
        F.col("ts").cast("timestamp").alias("ts_utc"), F.col("user_id").cast("string").alias("user"),
        "event_type", "value", F.get_json_object("props", "$.k").alias("k"),
        F.col("props").alias("raw"))


def one_source(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).withColumn("source_id", F.lit("all"))


# DuckDB side of ``events``.
EVENTS_SQL = """
ev AS (SELECT event_type AS source_id, event_id + 1 AS line_no, ts AS ts_utc,
              CAST(user_id AS VARCHAR) AS "user", event_type, value,
              json_extract_string(props, '$.k') AS k, props AS raw FROM events)
"""


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of every document: the document is the source."""
    docs = table(spark, folder, "documents")
    return docs.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_id"),
        F.posexplode(F.split("text", "\n")).alias("_pos", "raw")).select(
        "source_id", (F.col("_pos") + 1).cast("bigint").alias("line_no"), "raw")


DOC_LINES_SQL = """
dl AS (SELECT 'doc-' || doc_id AS source_id, unnest(range(1, len(parts) + 1)) AS line_no,
              unnest(parts) AS raw
       FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
"""
