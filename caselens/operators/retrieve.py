"""Search, windows, lookups and simple statistics over events."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import error_names
from ..schema import HIT_STATUSES, SEVERITIES
from ..session import broadcast_if_small, cut_lineage

# An estimate of one listed range in memory.
_RANGE_BYTES = 200
TIME_SLICE_MAX = 500


def parse_bound(text: str | None) -> datetime | None:
    """An ISO time bound; one with an offset is brought to UTC, one without is UTC."""
    if not text:
        return None
    value = datetime.fromisoformat(text)
    return value if value.tzinfo else value.replace(tzinfo=timezone.utc)


def field_condition(value: Column, wanted) -> Column:
    if isinstance(wanted, dict) and "contains" in wanted:
        return value.contains(str(wanted["contains"]))
    if isinstance(wanted, dict) and "eq" in wanted:
        wanted = wanted["eq"]
    return value == F.lit(str(wanted))


def apply_filters(events: DataFrame, q: str | None = None, field_filters: dict | None = None,
                  ts_from: str | None = None, ts_to: str | None = None,
                  source_id: str | None = None, case_id: str | None = None,
                  sources: DataFrame | None = None, text: str = "raw", ts: str = "ts_utc",
                  fields: str = "norm.") -> DataFrame:
    """AND of the given filters; every one is a plain comparison that a scan can push down.

    ``fields`` is the prefix of field columns: ``"norm."`` for events, ``""`` for flat
    tables. Unknown fields match nothing; keys that are no identifiers are ignored.
    """
    out = events
    if source_id is not None:
        out = out.where(F.col("source_id") == source_id)
    if case_id is not None:
        if sources is None:
            raise ValueError("a case filter needs the sources table")
        out = out.join(sources.where(F.col("case_id") == case_id).select("source_id"),
                       "source_id", "left_semi")
    if q:
        out = out.where(F.col(text).contains(q))
    known = set(events.columns)
    if field_filters and fields:
        known = set(events.schema[fields.rstrip(".")].dataType.names)
    for key, wanted in (field_filters or {}).items():
        if not key.replace("_", "").isalnum():
            continue
        out = out.where(field_condition(F.col(f"{fields}{key}").cast("string"), wanted)
                        if key in known else F.lit(False))
    low, high = parse_bound(ts_from), parse_bound(ts_to)
    if low is not None:
        out = out.where(F.col(ts) >= F.lit(low))
    if high is not None:
        out = out.where(F.col(ts) <= F.lit(high))
    return out


def search(events: DataFrame, limit: int = 50, offset: int = 0,
           order: tuple[str, ...] = ("source_id", "line_no"), **filters) -> DataFrame:
    """One page of matching events in line order; the page size is part of the request."""
    return apply_filters(events, **filters).orderBy(*order).offset(offset).limit(limit)


def search_total(events: DataFrame, **filters) -> DataFrame:
    return apply_filters(events, **filters).agg(F.count(F.lit(1)).alias("total"))


def scan_events(events: DataFrame, sources: DataFrame, case_id: str,
                source_id: str | None = None) -> DataFrame:
    """All events of a case, unordered: rules need no order between rows."""
    return apply_filters(events, case_id=case_id, sources=sources, source_id=source_id)


def read_window(events: DataFrame, source_id: str, line_from: int, line_to: int) -> DataFrame:
    return events.where((F.col("source_id") == source_id)
                        & F.col("line_no").between(line_from, line_to)).orderBy("line_no")


def lines_around(events: DataFrame, anchors: DataFrame, before: int = 100, after: int = 100,
                 block_lines: int = 4096) -> DataFrame:
    """Batch time slice: every event within the given distance of each anchor.

    ``anchors`` has source_id and anchor_line. The range condition becomes an equi-join on
    line blocks: an anchor is listed under every block its slice touches.
    """
    if not (0 <= before <= TIME_SLICE_MAX and 0 <= after <= TIME_SLICE_MAX):
        raise ValueError(f"before and after must be in 0..{TIME_SLICE_MAX}")
    low = F.greatest(F.lit(1), F.col("anchor_line") - before)
    slices = anchors.select("source_id", "anchor_line", low.alias("_lo"),
                            (F.col("anchor_line") + after).alias("_hi"))
    return join_line_ranges(events, slices, "_lo", "_hi", block_lines).drop("_lo", "_hi")


def join_line_ranges(events: DataFrame, ranges: DataFrame, low: str, high: str,
                     block_lines: int = 4096) -> DataFrame:
    """Inner join of events with line ranges of the same source.

    Ranges follow from findings and are few next to the events, so they are materialised
    and counted: as long as they are small, the events are not shuffled.
    """
    block = lambda c: F.floor(c / F.lit(block_lines))
    listed = cut_lineage(ranges.withColumn("_block", F.explode(F.sequence(
        block(F.col(low)), block(F.col(high))))))
    return (events.withColumn("_block", block(F.col("line_no")))
            .join(broadcast_if_small(listed, _RANGE_BYTES), ["source_id", "_block"])
            .where(F.col("line_no").between(F.col(low), F.col(high)))
            .drop("_block"))


def time_slice(events: DataFrame, source_id: str, line_no: int, before: int = 100,
               after: int = 100) -> DataFrame:
    if not (0 <= before <= TIME_SLICE_MAX and 0 <= after <= TIME_SLICE_MAX):
        raise ValueError(f"before and after must be in 0..{TIME_SLICE_MAX}")
    return read_window(events, source_id, max(1, line_no - before), line_no + after)


def entity_lookup(entities: DataFrame, value: str, cross_source: bool = False,
                  limit: int | None = None, offset: int = 0) -> DataFrame:
    """Occurrences of an entity by raw value or canonical key, in line order.

    All of them, or a page when ``limit`` asks for one; ``count()`` without it is the total.
    """
    out = entities.where((F.col("raw_value") == value) | (F.col("canonical_key") == value))
    if cross_source:
        out = out.where(F.col("qualifier") == "global")
    ordered = out.orderBy("source_id", "line_no").offset(offset)
    return ordered if limit is None else ordered.limit(limit)


def hit_id(hits: DataFrame) -> DataFrame:
    """``hits`` plus ``hit_id``, which follows from case, source, line and rule."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    sized = lambda c: F.concat(F.length(part(c)).cast("string"), F.lit(":"), part(c))
    return hits.withColumn("hit_id", F.substring(F.sha2(F.concat(
        *[sized(c) for c in ("case_id", "source_id", "line_no", "rule_id")]), 256), 1, 32))


def filter_hits(hits: DataFrame, status: str | None = None, severity: str | None = None,
                q: str | None = None, round_no: str | None = None, case_id: str | None = None,
                hit: str | None = None) -> DataFrame:
    """The hits of a review list; the keyword is ASCII case-insensitive.

    ``hit`` is one ``hit_id``; ``hits`` carries case_id where a case or a hit is asked for.
    """
    if status is not None and status not in HIT_STATUSES:
        raise ValueError(f"status must be one of {HIT_STATUSES}")
    if severity is not None and severity not in SEVERITIES:
        raise ValueError(f"severity must be one of {SEVERITIES}")
    out = hits
    if case_id is not None:
        out = out.where(F.col("case_id") == case_id)
    if status:
        out = out.where(F.col("status") == status)
    if severity:
        out = out.where(F.col("severity") == severity)
    if round_no == "history":
        out = out.where(F.col("round_no").isNull())
    elif round_no:
        if not (round_no.isdigit() and int(round_no) >= 1):
            raise ValueError("round_no must be a number from 1 or 'history'")
        out = out.where(F.col("round_no") == int(round_no))
    if q:
        upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
        fold = lambda c: F.translate(c, upper, lower)
        needle = fold(F.lit(q))
        out = out.where(
            fold(F.col("rule_id")).contains(needle)
            | fold(F.col("matched_value")).contains(needle)
            | fold(F.col("snippet")).contains(needle)
            | F.col("line_no").cast("string").contains(q))
    if hit:
        out = (out if "hit_id" in out.columns else hit_id(out)).where(F.col("hit_id") == hit)
        out = out.select(*hits.columns)
    return out


def list_hits(hits: DataFrame, status: str | None = None, severity: str | None = None,
              q: str | None = None, round_no: str | None = None, limit: int = 50,
              offset: int = 0, case_id: str | None = None, hit: str | None = None) -> DataFrame:
    """One page of ``filter_hits``; ``hits_total`` counts all of it."""
    out = filter_hits(hits, status, severity, q, round_no, case_id, hit)
    return out.orderBy("round_no", "rule_id", "source_id", "line_no").offset(offset).limit(limit)


def hits_total(hits: DataFrame, **filters) -> DataFrame:
    """total: how many hits ``list_hits`` pages through with the same filters."""
    return filter_hits(hits, **filters).agg(F.count(F.lit(1)).alias("total"))


def source_stats(events: DataFrame, source: str = "source_id", ts: str = "ts_utc") -> DataFrame:
    return events.groupBy(source).agg(
        F.count(F.lit(1)).alias("events"), F.min(ts).alias("ts_min"), F.max(ts).alias("ts_max"))


def value_counts(events: DataFrame, field: str, source: str = "source_id") -> DataFrame:
    """Distribution of a field per source; events without it are not counted."""
    value = F.col(field).cast("string")
    return events.where(value.isNotNull()).groupBy(source, value.alias("value")).agg(
        F.count(F.lit(1)).alias("count"))


def top_k(df: DataFrame, partition: list[str], order: list[Column], k: int,
          out: str = "rank") -> DataFrame:
    """The first ``k`` rows per group; Spark keeps only ``k`` rows per group and task."""
    ranked = df.withColumn(out, F.row_number().over(
        Window.partitionBy(*partition).orderBy(*order)))
    return ranked.where(F.col(out) <= k)


def top_values(events: DataFrame, field: str, n: int = 10, source: str = "source_id") -> DataFrame:
    """The ``n`` most frequent values per source, ties by value."""
    return top_k(value_counts(events, field, source), [source], [F.desc("count"), F.asc("value")], n)


def aggregate(events: DataFrame, field: str, limit: int = 20, fields: str = "norm.",
              **filters) -> DataFrame:
    """The ``limit`` largest buckets of a field under the search filters."""
    value = F.col(f"{fields}{field}").cast("string")
    found = apply_filters(events, fields=fields, **filters)
    return (found.where(value.isNotNull()).groupBy(value.alias("value"))
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "value").limit(limit))


def aggregate_total(events: DataFrame, fields: str = "norm.", **filters) -> DataFrame:
    """Events in scope, including those without the field."""
    return apply_filters(events, fields=fields, **filters).agg(
        F.count(F.lit(1)).alias("total_events"))


def ts_coverage(events: DataFrame, source: str = "source_id", ts: str = "ts_utc") -> DataFrame:
    return events.groupBy(source).agg(
        F.count(F.lit(1)).alias("events"), F.count(ts).alias("with_ts"))


def error_type_counts(lines: DataFrame, n: int = 100, order: str = "line_no",
                      text: str = "raw") -> DataFrame:
    """Error and exception names in the last ``n`` lines."""
    tail = lines.orderBy(F.desc(order)).limit(n)
    return tail.select(F.explode(error_names(F.col(text))).alias("name")).groupBy("name").agg(
        F.count(F.lit(1)).alias("count"))
