"""Format suggestions for unparsed files and the report of a parse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .access_logs import parse_apache_common, parse_nginx_combined, parse_raw
from .iis_logs import parse_iis_w3c

PARSERS = {
    "nginx_combined": parse_nginx_combined,
    "apache_common": parse_apache_common,
    "iis_w3c": parse_iis_w3c,
    "raw": parse_raw,
}
# Formats that are suggested, in this order, and their header patterns.
SUGGESTED = ["nginx_combined", "apache_common", "iis_w3c", "evtx"]
HEADER_PATTERNS = {"iis_w3c": r"^#Software:|^#Fields:", "evtx": r"^ElfFile\x00"}
HEADER_LINES = 10
THRESHOLD = 0.5
BAD_SAMPLES = 10


def detect_formats(sample: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per source the suggested formats with their hit rate on the sample, best first.

    ``sample`` holds the first non-blank lines of each source. A source without any
    suggestion has one row with a NULL format.
    """
    trials = []
    for order, name in enumerate(SUGGESTED):
        header = (F.col("raw").rlike(HEADER_PATTERNS[name]) & (F.col("line_no") <= HEADER_LINES)
                  if name in HEADER_PATTERNS else F.lit(False))
        parsed = PARSERS[name](sample) if name in PARSERS else sample.withColumn(
            "kind", F.lit("bad"))
        trials.append(parsed.groupBy("source_id").agg(
            F.count_if(F.col("kind") == "event").alias("_ok"),
            F.count_if(F.col("kind") == "bad").alias("_bad"),
            F.max(header).alias("header_hit"),
        ).select("source_id", F.lit(order).alias("_order"), F.lit(name).alias("format_id"),
                 F.when(F.col("_ok") + F.col("_bad") > 0,
                        F.col("_ok") / (F.col("_ok") + F.col("_bad"))).otherwise(0.0)
                 .alias("_rate"), "header_hit"))
    tried = reduce(DataFrame.unionByName, trials)
    kept = tried.where((F.col("_rate") > 0) | F.col("header_hit")).withColumn(
        "confidence", F.round("_rate", 4))
    # At most four rows per source.
    by_rank = Window.partitionBy("source_id").orderBy(F.desc("confidence"), "_order")
    ranked = kept.withColumn("rank", F.row_number().over(by_rank)).withColumn(
        "best", F.max("confidence").over(Window.partitionBy("source_id")))
    ok = F.coalesce(F.col("best") >= threshold, F.lit(False))
    return (sample.select("source_id").distinct().join(ranked, "source_id", "left")
            .select("source_id", "rank", "format_id", "confidence", "header_hit",
                    F.when(ok, "ok").otherwise("unknown").alias("verdict"),
                    F.when(~ok, "raw").alias("fallback")))


def parse_report(parsed: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Per source: counts, the first bad lines, time range and status.

    A source whose lines are all bad has failed. Bad samples are cut to ten per source
    before they are collected.
    """
    counts = parsed.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.count_if(F.col("kind") == "event").alias("parsed"),
        F.count_if(F.col("kind") == "bad").alias("bad_lines"),
        F.count_if(F.col("kind") == "skip").alias("skipped_lines"))
    first = Window.partitionBy("source_id").orderBy("line_no")
    samples = (
        parsed.where(F.col("kind") == "bad").select("source_id", "line_no", "reason")
        .withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= BAD_SAMPLES)
        .groupBy("source_id").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("line_no", "reason"))),
            lambda s: F.concat(F.lit("L"), s["line_no"].cast("string"), F.lit(": "), s["reason"]))
            .alias("bad_samples")))
    report = counts.join(samples, "source_id", "left").withColumn(
        "bad_samples", F.coalesce("bad_samples", F.array().cast("array<string>")))
    if events is not None:
        report = report.join(events.groupBy("source_id").agg(
            F.min("ts_utc").alias("ts_min"), F.max("ts_utc").alias("ts_max")),
            "source_id", "left")
    return report.withColumn("status", F.when(
        (F.col("parsed") == 0) & (F.col("bad_lines") > 0), "failed").otherwise("parsed"))
