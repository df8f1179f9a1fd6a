"""The batch transforms on Structured Streaming inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.signatures import signature_scan
from ..sources.access_logs import parse_nginx_combined


def stream_log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of files dropped into ``folder``.

    A stream has no line numbers; a line is known by its file and the hash of its text.
    """
    return spark.readStream.text(folder).select(
        F.col("_metadata.file_path").alias("source_id"),
        F.xxhash64("value").alias("line_no"), F.col("value").alias("raw"))


def stream_signature_scan(lines: DataFrame, rules: list[dict], log_type: str = "web") -> DataFrame:
    """Stateless parse and signature match of combined log lines; works on batches too."""
    events = parse_nginx_combined(lines).where(F.col("kind") == "event").withColumn(
        "ts_utc", F.col("ts_direct"))
    return signature_scan(events.withColumn("log_type", F.lit(log_type)), None, rules)


def stream_rate_buckets(events: DataFrame, keys: list[str], bucket_seconds: int, delay: str,
                        ts: str = "ts_utc") -> DataFrame:
    """Tumbling counts per key; a bucket is final once the watermark has passed it."""
    return (events.withWatermark(ts, delay)
            .groupBy(F.window(ts, f"{bucket_seconds} seconds"), *keys)
            .agg(F.count(F.lit(1)).alias("count"))
            .select(*keys, F.unix_seconds("window.start").alias("bucket"), "count"))
