"""Signature rules as one pass of Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import first_token

SNIPPET_CHARS = 300


def _lowered(field: str) -> str:
    return f"_low_{field}"


def rule_match(rule: dict) -> Column:
    """Struct of the match, NULL without one: every field must hold one of its tokens; the
    first declared field is reported with its first listed token."""
    fields = list(rule["match"])
    holds = [reduce(lambda a, b: a | b,
                    [F.col(_lowered(f)).contains(t) for t in rule["match"][f]]) for f in fields]
    condition = reduce(lambda a, b: a & b, holds)
    if rule["target"] != "any":
        condition = (F.col("log_type") == rule["target"]) & condition
    return F.when(condition, F.struct(
        F.lit(rule["id"]).alias("rule_id"), F.lit(rule["severity"]).alias("severity"),
        F.lit(fields[0]).alias("matched_field"),
        first_token(F.col(_lowered(fields[0])), rule["match"][fields[0]]).alias("matched_value")))


def signature_scan(events: DataFrame, sources: DataFrame | None, rules: list[dict],
                   fields: dict[str, str] | None = None) -> DataFrame:
    """One row per event and matching rule, without shuffle.

    ``fields`` maps rule fields to columns, by default ``norm.<field>`` and ``raw``. A
    missing field matches nothing. ``sources`` gives the log type; without it the events
    carry a ``log_type`` column.
    """
    used = list(dict.fromkeys(f for r in rules for f in r["match"]))
    column = lambda f: (fields or {}).get(f, "raw" if f == "raw" else f"norm.{f}")
    text = column("raw")
    if sources is not None:
        events = events.join(sources.select("source_id", "log_type"), "source_id")
    ready = events.select(
        "source_id", "line_no", "ts_utc", "log_type",
        F.substring(F.col(text), 1, SNIPPET_CHARS).alias("snippet"),
        *[F.lower(F.col(column(f)).cast("string")).alias(_lowered(f)) for f in used])
    matched = ready.select(
        "source_id", "line_no", "ts_utc", "snippet",
        F.explode(F.array_compact(F.array(*[rule_match(r) for r in rules]))).alias("m"))
    return matched.select("source_id", "line_no", "ts_utc", "m.*", "snippet")
