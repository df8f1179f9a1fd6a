"""Turning written window readings into hits for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FINDING_RULE_ID, SEVERITIES
from ..session import cut_lineage

# Fixed value: a JSON object inside a code fence.
FENCED = r"(?s)```(?:json)?\s*(\{.*\})\s*```"
_KEY = ["source_id", "line_from", "line_to"]
# Earlier findings go first; the fields after ``seq`` only settle ties.
_ORDER = ("line_from", "seq", "source_id", "line_to", "run_id", "severity", "summary", "line_refs")


def _typed(value: Column, path: str, kind: str, target: str) -> Column:
    """What ``value`` holds at ``path`` if it is of that JSON kind, else null."""
    return F.when(F.schema_of_variant(F.variant_get(value, path, "variant")).startswith(kind),
                  F.try_variant_get(value, path, target))


def _finding(item: Column) -> Column:
    """One finding with nulls where the reply does not hold what the field asks for."""
    return F.struct(
        _typed(item, "$.suspicion", "STRING", "string").alias("severity"),
        F.trim(_typed(item, "$.summary", "STRING", "string")).alias("summary"),
        F.transform(
            F.filter(F.coalesce(_typed(item, "$.line_refs", "ARRAY", "array<variant>"),
                                F.array().cast("array<variant>")),
                     lambda ref: F.schema_of_variant(ref) == "BIGINT"),
            lambda ref: F.variant_get(ref, "$", "bigint")).alias("line_refs"))


def read_replies(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reply status, valid findings).

    ``replies``: run_id, source_id, line_from, line_to, first_anchor, content. The object of a
    reply stands in a code fence, alone, or between the outermost braces. A reply without one,
    or one that repeats a key in it, is 'unreadable'; invalid findings are counted, not kept.
    """
    base = ["run_id", *_KEY, "first_anchor"]
    fenced = F.regexp_extract("content", FENCED, 1)
    body = replies.select(*base, F.when(fenced != "", fenced).otherwise(
        F.trim("content")).alias("_body"))
    parsed = body.select(*base, F.coalesce(
        F.try_parse_json("_body"),
        F.try_parse_json(F.regexp_extract("_body", r"(?s)\{.*\}", 0))).alias("_any"))
    known = parsed.select(*base, F.when(
        F.schema_of_variant("_any").startswith("OBJECT"), F.col("_any")).alias("_reply"))
    listed = F.schema_of_variant(F.variant_get("_reply", "$.findings", "variant"))
    items = known.select(
        *base, F.when(F.col("_reply").isNull(), "unreadable").otherwise("read").alias("status"),
        _typed(F.col("_reply"), "$.window_note", "STRING", "string").alias("window_note"),
        # Anything but a list counts as one invalid finding, unless it is empty.
        F.when(listed.isNull() | listed.startswith("ARRAY") | (listed == "VOID"), 0)
        .otherwise(1).alias("_odd"),
        F.coalesce(_typed(F.col("_reply"), "$.findings", "ARRAY", "array<variant>"),
                   F.array().cast("array<variant>")).alias("_items"))
    checked = items.withColumn("_good", F.filter(
        F.transform("_items", _finding),
        lambda f: f["severity"].isin(*SEVERITIES) & (f["summary"] != "")))
    read = checked.select(
        *base, "status", (F.col("_odd") + F.size("_items") - F.size("_good")).alias("skipped"),
        "window_note")
    findings = checked.select(*base, F.posexplode("_good").alias("seq", "_f")).select(
        *base, "seq", "_f.*")
    return read, findings


def findings_to_hits(findings: DataFrame, hits: DataFrame) -> DataFrame:
    """Pending hits from findings; a line holds at most one finding per source.

    A finding takes the first free line among its references inside the window, then the
    anchor of the window; without a free line it adds nothing. Earlier findings go first.

    All findings bid at once for the first line they have not lost, every line keeps its
    earliest bidder, and the others bid on. As all lines prefer earlier findings, the end is
    the one of serving findings one by one. A round is one exchange of bids by line.
    """
    inside = F.filter("line_refs", lambda r: r.between(F.col("line_from"), F.col("line_to")))
    placed = cut_lineage(findings.select(
        *_ORDER, "first_anchor", (F.size("line_refs") - F.size(inside)).alias("outside"),
        F.array_distinct(F.concat(inside, F.array("first_anchor"))).alias("_lines"))
        .withColumn("_copy", F.row_number().over(
            Window.partitionBy(*_ORDER).orderBy("first_anchor")))
        .withColumn("_id", F.struct(*[c for c in _ORDER if c != "source_id"], "_copy")))
    used = hits.where(F.col("rule_id") == FINDING_RULE_ID).select("source_id", "line_no").distinct()
    options = placed.select("source_id", "_id", F.posexplode("_lines").alias("_nth", "line_no"))
    open_bids = cut_lineage(options.join(used, ["source_id", "line_no"], "left_anti"))

    def bids(rows: DataFrame) -> DataFrame:
        """The line each finding asks for next, and the earliest finding that asks for it."""
        asked = rows.groupBy("source_id", "_id").agg(F.min_by("line_no", "_nth").alias("line_no"))
        first = asked.groupBy("source_id", "line_no").agg(F.min("_id").alias("_first"))
        return asked.join(first, ["source_id", "line_no"])

    while True:
        asked = cut_lineage(bids(open_bids))
        lost = asked.where(F.col("_id") != F.col("_first")).select("source_id", "line_no", "_id")
        if lost.isEmpty():
            break
        open_bids = cut_lineage(open_bids.join(lost, ["source_id", "line_no", "_id"], "left_anti"))
    chosen = placed.join(
        asked.select("source_id", "_id", "line_no"), ["source_id", "_id"])
    detail = F.to_json(F.struct(
        F.lit("ai_finding").alias("kind"), "run_id",
        F.struct(F.col("line_from").alias("from"), F.col("line_to").alias("to")).alias("window"),
        "line_refs", F.when(F.col("outside") > 0, F.col("outside")).alias("out_of_window_refs"),
        F.lit(False).alias("triple_negative")))
    return chosen.select(
        "source_id", "line_no", F.lit(FINDING_RULE_ID).alias("rule_id"), "severity",
        F.lit("ai_finding").alias("matched_field"), F.col("severity").alias("matched_value"),
        F.substring("summary", 1, 300).alias("snippet"),
        F.lit(None).cast("timestamp").alias("ts_utc"), F.lit("pending").alias("status"),
        detail.alias("detail"))
