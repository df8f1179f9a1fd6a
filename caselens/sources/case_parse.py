"""Parsing a case end to end: verify, read, dispatch by format, normalise, store, report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage, new_folder
from .descriptors import parse_descriptor
from .detect import PARSERS, parse_report
from .files import file_inventory, verify_files
from .lines import plain_path, read_log_lines
from .normalize import build_events, extract_entities
from .tables import read_stored, write_entities, write_events

_PARSED = ["source_id", "line_no", "kind", "reason", "raw", "ts_raw", "dt_local", "ts_direct",
           "norm", "extras"]


def verify_sources(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """``sources`` plus ``state``: ok, mismatch or missing, from one streamed hash per file."""
    paths = sources.select(plain_path("path").alias("path"), "sha256")
    roots = [r["root"] for r in sources.select(
        F.regexp_replace("path", "/[^/]*$", "").alias("root")).distinct().collect()]
    found = file_inventory(spark, roots, paths).withColumn("path", plain_path("path"))
    states = verify_files(found, paths).select(F.col("path").alias("_path"), "state").distinct()
    return sources.withColumn("_path", plain_path("path")).join(states, "_path", "left").withColumn(
        "state", F.coalesce("state", F.lit("missing"))).drop("_path")


def parse_lines(lines: DataFrame, sources: DataFrame, descriptors: dict[str, dict]) -> DataFrame:
    """Every line parsed by the format its source declares.

    ``descriptors`` maps further format ids to their descriptors. The formats of a case are
    few; each gets the lines of its own sources.
    """
    declared = [r["format_id"] for r in sources.select("format_id").distinct().collect()]
    parts = []
    for name in sorted(declared):
        own = lines.join(F.broadcast(sources.where(F.col("format_id") == name).select("source_id")),
                         "source_id", "left_semi")
        parsed = PARSERS[name](own) if name in PARSERS else parse_descriptor(own, descriptors[name])
        have = set(parsed.columns)
        parts.append(parsed.select(*[
            F.col(c) if c in have else F.lit(None).cast(
                "timestamp" if c == "ts_direct" else "string").alias(c) for c in _PARSED]))
    return reduce(DataFrame.unionByName, parts)


def parse_case(spark: SparkSession, sources: DataFrame, folder: str,
               descriptors: dict[str, dict] | None = None) -> DataFrame:
    """Parse all sources of a case into ``folder``/events and ``folder``/entities.

    ``sources``: path, source_id, sha256, format_id, tz_declared and optionally encoding.
    Returns the report, one row per source. A file that is missing or altered is not read,
    and neither is one of an unknown format; both are reported as failed with the reason, and
    what an earlier parse of them has stored stays. A source that was read replaces its rows,
    also by none. Lines are parsed once; events, entities and the report come from the stored
    parse.
    """
    known = sorted({*PARSERS, *(descriptors or {})})
    # Read once: a list that is made anew may name other files each time.
    sources = cut_lineage(sources)
    checked = cut_lineage(verify_sources(spark, sources).withColumn("reason", F.when(
        F.col("state") == "missing", "file missing").when(
        F.col("state") != "ok", "file altered").when(
        ~F.coalesce(F.col("format_id").isin(known), F.lit(False)), "unknown format")))
    good = checked.where(F.col("reason").isNull()).drop("reason", "state")
    paths = [r["path"] for r in good.select("path").toLocalIterator()]
    refused = checked.where(F.col("reason").isNotNull()).select(
        "source_id", F.lit("failed").alias("status"), "reason")
    if not paths:
        return refused
    work = new_folder(spark, "parsed")
    parse_lines(read_log_lines(spark, paths, good), good, descriptors or {}).write.parquet(work)
    parsed = spark.read.parquet(work)
    events = build_events(parsed, good)
    write_events(events, f"{folder}/events", good)
    stored = read_stored(spark, f"{folder}/events", events.schema).join(
        broadcast_if_small(good.select("source_id"), 100), "source_id", "left_semi").select(*events.columns)
    write_entities(extract_entities(stored), f"{folder}/entities", good)
    report = parse_report(parsed, stored)
    empty = good.select("source_id").join(report.select("source_id"), "source_id", "left_anti").select(
        "source_id", F.lit("parsed").alias("status"))
    return report.unionByName(empty, True).unionByName(refused, True)
