"""Deterministic explanations of paths, agents and status codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import EXPLANATIONS

KINDS = ["path", "ua", "status"]


def explain(df: DataFrame, column: str, kind: str, entries: list[tuple[str, str]] | None = None,
            out: str = "explanation") -> DataFrame:
    """Add ``covered`` and ``out``: the first entry whose token occurs in the value, or the
    exact entry for a status. The entries are configuration, so they become a CASE."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    entries = EXPLANATIONS[kind] if entries is None else entries
    value = F.trim(F.col(column).cast("string"))
    low = F.lower(value)
    match = (lambda t: value == t) if kind == "status" else (lambda t: low.contains(t.lower()))
    text = F.coalesce(F.lit(None).cast("string"),
                      *[F.when(match(token), F.lit(note)) for token, note in entries])
    return df.withColumn(out, F.when(value != "", text)).withColumn(
        "covered", F.col(out).isNotNull())
