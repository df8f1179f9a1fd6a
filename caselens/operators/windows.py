"""Line windows around findings: seeding, merging, excerpts and what stands inside."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FINDING_RULE_ID
from .ordered import carry_forward
from .retrieve import join_line_ranges, top_k

# Overlap that merges windows, and the limits of an excerpt.
OVERLAP_RATIO = 0.10
DEFAULT_WINDOW = 200
EXCERPT_LINES = 500
EXCERPT_CHARS = 160_000
LINE_OVERHEAD = 10


def pending_anchors(hits: DataFrame) -> DataFrame:
    """Distinct lines of pending hits; findings of the analysis itself do not seed it."""
    return (hits.where((F.col("status") == "pending") & (F.col("rule_id") != FINDING_RULE_ID))
            .select("source_id", F.col("line_no").alias("anchor_line")).distinct())


def merge_windows(anchors: DataFrame, n: int = DEFAULT_WINDOW,
                  sources: DataFrame | None = None) -> DataFrame:
    """Windows of ``n`` lines to both sides of each anchor; neighbours that overlap by at
    least a tenth of a window become one.

    Window ends only grow, so an anchor joins the window of the anchor before it or opens
    a new one. Both "the anchor before" and "the opening anchor" are carried over line
    blocks, which keeps one source from becoming one task. ``sources`` (source_id,
    line_count) cuts windows at the last line.
    """
    threshold = max(1, int((2 * n + 1) * OVERLAP_RATIO))
    points = anchors.select("source_id", "anchor_line").distinct()
    linked = carry_forward(points, ["source_id"], "anchor_line", F.col("anchor_line"), "_before",
                           strict=True)
    low = F.greatest(F.lit(1), F.col("anchor_line") - n)
    overlap = F.col("_before") + n - low + 1
    opens = F.col("_before").isNull() | (overlap < threshold)
    placed = carry_forward(linked.withColumn("_opens", opens), ["source_id"], "anchor_line",
                           F.when(F.col("_opens"), F.col("anchor_line")), "_window")
    out = placed.groupBy("source_id", "_window").agg(
        F.min("anchor_line").alias("first_anchor"), F.max("anchor_line").alias("last_anchor"),
        F.count(F.lit(1)).alias("anchors"))
    out = out.select(
        "source_id", F.greatest(F.lit(1), F.col("first_anchor") - n).alias("line_from"),
        (F.col("last_anchor") + n).alias("line_to"), "first_anchor", "anchors")
    if sources is not None:
        out = (out.join(sources.select("source_id", "line_count"), "source_id", "left")
               .withColumn("line_to", F.when(F.col("line_count") > 0, F.least(
                   "line_to", "line_count")).otherwise(F.col("line_to")))
               .drop("line_count"))
    return out


def rank_windows(windows: DataFrame, anchors: DataFrame, scores: DataFrame) -> DataFrame:
    """Windows with the highest linkage score of their anchors, strongest first.

    A source none of whose events has a score keeps line order and a NULL score.
    """
    scored = anchors.select("source_id", F.col("anchor_line").alias("line_no")).join(
        scores, ["source_id", "line_no"])
    best = join_line_ranges(scored, windows.select("source_id", "line_from", "line_to"),
                            "line_from", "line_to").groupBy(
        "source_id", "line_from", "line_to").agg(F.max("score").alias("_best"))
    any_score = scores.select("source_id", F.lit(True).alias("_any")).distinct()
    return (windows.join(best, ["source_id", "line_from", "line_to"], "left")
            .join(any_score, "source_id", "left")
            .withColumn("linkage_score", F.when(F.col("_any"), F.round(
                F.coalesce("_best", F.lit(0.0)), 6)))
            .drop("_best", "_any")
            .orderBy("source_id", F.desc_nulls_last("linkage_score"), "line_from"))


def window_excerpts(windows: DataFrame, events: DataFrame, max_lines: int = EXCERPT_LINES,
                    max_chars: int = EXCERPT_CHARS, text: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(window with counts and what cut it, excerpt lines).

    Only the first ``max_lines`` lines of a window can be shown, so each task keeps no more
    than those; the character limit is a running sum over them.
    """
    key = ["source_id", "line_from", "line_to"]
    inside = join_line_ranges(events.select("source_id", "line_no", F.col(text).alias("raw")),
                              windows.select(*key), "line_from", "line_to")
    sizes = inside.groupBy(*key).agg(F.count(F.lit(1)).alias("lines"))
    first = top_k(inside, key, [F.asc("line_no")], max_lines, "_n")
    upto = Window.partitionBy(*key).orderBy("line_no").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    shown = first.withColumn("_chars", F.sum(F.length("raw") + LINE_OVERHEAD).over(upto)).where(
        F.col("_chars") <= max_chars)
    counted = shown.groupBy(*key).agg(F.count(F.lit(1)).alias("shown"))
    summary = (windows.select(*key).join(sizes, key, "left").join(counted, key, "left")
               .withColumn("lines", F.coalesce("lines", F.lit(0)))
               .withColumn("shown", F.coalesce("shown", F.lit(0)))
               .withColumn("truncated_by", F.when(
                   F.col("lines") > F.col("shown"),
                   F.when(F.col("shown") < F.least(F.col("lines"), F.lit(max_lines)), "chars")
                   .otherwise("lines"))))
    return summary, shown.drop("_n", "_chars")


def window_standing_hits(windows: DataFrame, hits: DataFrame) -> DataFrame:
    """Pending or accepted hits inside each window, findings of the analysis left out."""
    standing = hits.where(F.col("status").isin("pending", "accepted")
                          & (F.col("rule_id") != FINDING_RULE_ID))
    return join_line_ranges(standing, windows.select("source_id", "line_from", "line_to"),
                            "line_from", "line_to")


def triple_negative(windows: DataFrame, findings: DataFrame, hits: DataFrame,
                    known_rules: list[str]) -> DataFrame:
    """Read windows without an anomaly: 'clean' when no deterministic hit stands inside
    either, else 'suppressed'.

    ``findings``: source_id, line_from, line_to, severity of the valid findings per window.
    ``known_rules``: ids of signature, statistical and cross-source rules.
    """
    key = ["source_id", "line_from", "line_to"]
    odd = findings.where(F.col("severity").isin("high", "medium", "low")).select(*key).distinct()
    standing = (window_standing_hits(windows, hits)
                .where(F.col("rule_id").isin(known_rules)).select(*key).distinct()
                .withColumn("_standing", F.lit(True)))
    return (windows.join(odd, key, "left_anti").join(standing, key, "left")
            .withColumn("verdict", F.when(F.col("_standing"), "suppressed").otherwise("clean"))
            .drop("_standing"))
