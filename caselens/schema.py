"""Table shapes shared by parsers and operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The vocabulary of normalised fields.
RULE_FIELDS = [
    "src_ip", "method", "path", "query", "status", "bytes", "ua", "referer",
    "trace_id", "session_id", "user", "level", "logger", "message",
    "actor", "action", "object", "result",
]
DESCRIPTOR_FIELDS = [
    "src_ip", "method", "path", "query", "status", "bytes", "ua", "referer",
    "actor", "action", "object", "result", "detail",
    "level", "logger", "message", "exception",
]
EVENT_RECORD_FIELDS = [
    "channel", "event_id", "provider", "computer",
    "ipport", "workstationname", "processname", "targetdomainname",
]
NORM_FIELDS = RULE_FIELDS + ["xff", "detail", "exception"] + EVENT_RECORD_FIELDS
SEVERITIES = ["info", "low", "medium", "high"]
LOG_TYPES = ["web", "middleware", "audit", "unknown"]
HIT_STATUSES = ["pending", "accepted", "rejected"]
FINDING_RULE_ID = "ai-l3-finding"
CROSS_SOURCE_RULE_ID = "cross-source-entity"

NORM = T.StructType([T.StructField(f, T.StringType()) for f in NORM_FIELDS])

LINES = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("line_no", T.LongType()),
    T.StructField("raw", T.StringType()),
])

PARSED = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("line_no", T.LongType()),
    T.StructField("kind", T.StringType()),            # event | bad | skip
    T.StructField("raw", T.StringType()),
    T.StructField("ts_raw", T.StringType()),
    T.StructField("dt_local", T.TimestampNTZType()),
    T.StructField("ts_direct", T.TimestampType()),    # already UTC in the log itself
    T.StructField("norm", NORM),
    T.StructField("extras", T.StringType()),          # JSON object
    T.StructField("reason", T.StringType()),
    T.StructField("continuation_lines", T.IntegerType()),
])

EVENTS = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("line_no", T.LongType()),
    T.StructField("ts_raw", T.StringType()),
    T.StructField("ts_utc", T.TimestampType()),
    T.StructField("norm", NORM),
    T.StructField("extras", T.StringType()),
    T.StructField("raw", T.StringType()),
    T.StructField("sha256", T.StringType()),
])

ENTITIES = T.StructType([
    T.StructField("raw_value", T.StringType()),
    T.StructField("canonical_key", T.StringType()),
    T.StructField("entity_type", T.StringType()),
    T.StructField("qualifier", T.StringType()),       # global | host_scoped
    T.StructField("source_id", T.StringType()),
    T.StructField("line_no", T.LongType()),
    T.StructField("ts_utc", T.TimestampType()),
])

HITS = T.StructType([
    T.StructField("case_id", T.StringType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("line_no", T.LongType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("matched_field", T.StringType()),
    T.StructField("matched_value", T.StringType()),
    T.StructField("snippet", T.StringType()),
    T.StructField("ts_utc", T.TimestampType()),
    T.StructField("status", T.StringType()),
    T.StructField("detail", T.StringType()),          # JSON object
    T.StructField("round_no", T.IntegerType()),
    T.StructField("within_budget", T.BooleanType()),
])
HIT_KEY = ["source_id", "line_no", "rule_id"]


def norm_struct(fields: dict[str, Column]) -> Column:
    """The full ``norm`` struct with every field that is not given left NULL."""
    return F.struct(*[
        fields.get(name, F.lit(None)).cast("string").alias(name) for name in NORM_FIELDS
    ])


def flatten(events: DataFrame, fields: list[str], keep: list[str] | None = None) -> DataFrame:
    """Events with the wanted ``norm`` fields as top-level columns.

    Only those nested columns are read from Parquet.
    """
    base = keep or ["source_id", "line_no", "ts_utc"]
    return events.select(*base, *[F.col(f"norm.{f}").alias(f) for f in dict.fromkeys(fields)])
