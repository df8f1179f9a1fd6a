"""Line formats without state: nginx combined, Apache common and raw text.

A line is matched once: the pattern rewrites it into its groups joined by a separator,
and the parts are then picked from the split array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    compute_once, forwarded_for, is_blank, request_parts, split_request)
from ..schema import norm_struct

# Line shapes and the time shape of access logs.
COMBINED_PATTERN = (
    r'(?sU)\A(\S+) \S+ (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}) (\S+) "([^"]*)" "([^"]*)"(.*)\z')
COMMON_PATTERN = r'(?sU)\A(\S+) \S+ (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}) (\S+)\s*\z'
TIME_PATTERN = r"^\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}$"
TIME_FORMAT = "dd/MMM/yyyy:HH:mm:ss"

_SEP = "\u0001"


def _with_groups(lines: DataFrame, pattern: str, n: int) -> DataFrame:
    """Add ``_g``: array of the ``n`` groups, NULL when the line does not match."""
    raw = F.col("raw")
    joined = _SEP.join(f"${i}" for i in range(1, n + 1))
    split_once = compute_once(lines, _parts=F.when(~F.col("_blank"), F.split(
        F.regexp_replace(raw, pattern, joined), _SEP)))
    # A line that holds the separator itself is taken apart group by group.
    slow = F.when(raw.rlike(pattern), F.array(
        *[F.regexp_extract(raw, pattern, i) for i in range(1, n + 1)]))
    return compute_once(split_once, _g=F.when(raw.contains(_SEP), slow).when(
        F.size("_parts") == n, F.col("_parts"))).drop("_parts")


def _dash(text: Column) -> Column:
    return F.when((text != "-") & (text != ""), text)


def _access_log(lines: DataFrame, pattern: str, n: int, no_match: str, bad_time: str) -> DataFrame:
    g = F.col("_g")
    item = lambda i: F.get(g, F.lit(i))
    time_text = F.trim(item(2))
    size = item(5)
    size_number = F.col("_size")
    trailing = F.trim(item(8)) if n > 8 else F.lit("")
    xff = F.col("_xff")
    staged = compute_once(lines, _blank=is_blank(F.col("raw")))
    staged = _with_groups(staged, pattern, n)
    staged = compute_once(
        staged, _trail=trailing, _request=request_parts(item(3)),
        _size=F.when(size.rlike(r"^[+-]?\d+$"), F.coalesce(
            size.try_cast("bigint").cast("string"),
            size.try_cast("decimal(38,0)").cast("string"))),
        _dt=F.when(time_text.rlike(TIME_PATTERN), F.try_to_timestamp(
            F.substring(time_text, 1, 20), F.lit(TIME_FORMAT))).cast("timestamp_ntz"))
    staged = compute_once(staged, _xff=F.when(
        F.col("_trail") != "", forwarded_for(F.col("_trail"))))
    request = split_request(item(3), F.col("_request"))
    reason = (
        F.when(F.col("_blank"), F.lit("blank line"))
        .when(g.isNull(), F.lit(no_match))
        .when(F.col("_dt").isNull(), F.lit(bad_time))
        .when((size != "-") & size_number.isNull(), F.lit("byte count is not a number")))
    norm = {
        "src_ip": item(0), "user": _dash(item(1)),
        "method": request["method"], "path": request["path"], "query": request["query"],
        "status": item(4).cast("int").cast("string"),
        "bytes": F.when(size != "-", size_number),
    }
    extras = {
        "request": request["unparsed"], "protocol": request["protocol"],
        "time_offset": F.substring(time_text, 22, 5),
    }
    if n > 8:
        norm |= {"referer": _dash(item(6)), "ua": _dash(item(7)), "xff": xff}
        extras["trailing"] = F.when((F.col("_trail") != "") & xff.isNull(), F.col("_trail"))
    staged = compute_once(staged, reason=reason)
    staged = compute_once(staged, kind=F.when(F.col("_blank"), "skip").when(
        F.col("reason").isNotNull(), "bad").otherwise("event"))
    is_event = F.col("kind") == "event"
    return staged.select(
        "source_id", "line_no", "kind", "raw",
        F.when(g.isNotNull(), item(2)).alias("ts_raw"),
        F.when(is_event, F.col("_dt")).alias("dt_local"),
        F.lit(None).cast("timestamp").alias("ts_direct"),
        F.when(is_event, norm_struct(norm)).alias("norm"),
        F.when(is_event, F.to_json(F.struct(
            *[c.alias(k) for k, c in extras.items()]))).alias("extras"),
        "reason", F.lit(0).alias("continuation_lines"))


def parse_nginx_combined(lines: DataFrame) -> DataFrame:
    return _access_log(lines, COMBINED_PATTERN, 9, "no combined log line", "unreadable time")


def parse_apache_common(lines: DataFrame) -> DataFrame:
    return _access_log(lines, COMMON_PATTERN, 6, "no common log line", "unreadable time")


def parse_raw(lines: DataFrame) -> DataFrame:
    """Every non-blank line is an event without normalised fields or time."""
    blank = is_blank(F.col("raw"))
    return lines.select(
        "source_id", "line_no", F.when(blank, "skip").otherwise("event").alias("kind"), "raw",
        F.lit(None).cast("string").alias("ts_raw"),
        F.lit(None).cast("timestamp_ntz").alias("dt_local"),
        F.lit(None).cast("timestamp").alias("ts_direct"),
        F.when(~blank, norm_struct({})).alias("norm"),
        F.lit(None).cast("string").alias("extras"),
        F.when(blank, "blank line").alias("reason"), F.lit(0).alias("continuation_lines"))
