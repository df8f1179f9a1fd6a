"""The case journal and the anchors of its notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage

NOTE_MAX_CHARS = 4000
# Order of entries of the same moment.
KIND_ORDER = {"note": 0, "scan": 1, "ai": 2}


def journal_entries(rounds: DataFrame, runs: DataFrame, notes: DataFrame) -> DataFrame:
    """Scan rounds, analysis runs and notes as one table of entries.

    ``rounds``: case_id, round_no, rule_count (NULL = all), actor, scanned, hits_new,
    truncated, created_at; ``runs``: case_id, run_id, status, anchors, windows, findings,
    error, created_at; ``notes``: case_id, note_id, body, anchor_kind, anchor_ref, author,
    created_at.
    """
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
    scans = rounds.select(
        "case_id", F.lit("scan").alias("kind"), F.col("created_at").alias("ts"),
        F.col("actor").alias("author"),
        F.concat(F.lit("scan round "), F.col("round_no").cast("string")).alias("title"),
        F.when(F.col("scanned").isNull(), F.lit("no summary")).otherwise(F.concat(
            F.coalesce(F.concat(F.col("rule_count").cast("string"), F.lit(" rules")),
                       F.lit("all rules")),
            F.lit(" | scanned "), number("scanned"), F.lit(" | new "), number("hits_new"),
            F.when(F.col("truncated") > 0, F.concat(F.lit(" | truncated "), number("truncated")))
            .otherwise(F.lit("")))).alias("body"),
        F.lit("scan_round").alias("anchor_kind"),
        F.col("round_no").cast("string").alias("anchor_ref"))
    analyses = runs.select(
        "case_id", F.lit("ai").alias("kind"), F.col("created_at").alias("ts"),
        F.lit(None).cast("string").alias("author"), F.lit("analysis").alias("title"),
        F.when(F.col("error").isNotNull(), F.concat(
            F.col("status"), F.lit(" | error: "), F.col("error")))
        .when(F.col("anchors").isNull(), F.concat(F.col("status"), F.lit(" | no summary")))
        .otherwise(F.concat(
            F.col("status"), F.lit(" | anchors "), number("anchors"), F.lit(" | windows "),
            number("windows"), F.lit(" | findings "), number("findings"))).alias("body"),
        F.lit("analysis_run").alias("anchor_kind"), F.col("run_id").alias("anchor_ref"))
    written = notes.select(
        "case_id", F.lit("note").alias("kind"), F.col("created_at").alias("ts"), "author",
        F.lit("note").alias("title"), "body", "anchor_kind", "anchor_ref")
    return scans.unionByName(analyses).unionByName(written)


def journal(rounds: DataFrame, runs: DataFrame, notes: DataFrame, case_id: str,
            limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of the journal, newest first."""
    rank = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in KIND_ORDER.items()])
    entries = journal_entries(rounds, runs, notes).where(F.col("case_id") == case_id)
    return entries.orderBy(F.desc("ts"), rank, "anchor_ref", "body").offset(offset).limit(limit)


def validate_notes(notes: DataFrame, hits: DataFrame, rounds: DataFrame, runs: DataFrame,
                   events: DataFrame, sources: DataFrame) -> DataFrame:
    """Notes with ``problem``: empty or too long text, or an anchor that does not exist.

    ``hits`` needs hit_id and case_id. Each anchor kind is one join of the notes of that
    kind with what they point at; the event table is only probed for noted lines.
    """
    ref = F.trim("anchor_ref")
    numbered = (notes.withColumn("_ref", ref)
                .withColumn("_source", F.regexp_extract("_ref", r"(?s)^(.*):(\d+)$", 1))
                .withColumn("_line", F.when(
                    F.col("anchor_kind") == "line",
                    F.regexp_extract("_ref", r"(?s)^(.*):(\d+)$", 2).try_cast("bigint")))
                .withColumn("_round", F.when(
                    (F.col("anchor_kind") == "scan_round") & F.col("_ref").rlike(r"^\d+$"),
                    F.col("_ref").try_cast("bigint"))))
    found = lambda df, **names: df.select(
        *[F.col(old).alias(new) for new, old in names.items()]).distinct()
    by_hit = found(hits, case_id="case_id", _ref="hit_id").withColumn("_hit_ok", F.lit(True))
    by_round = found(rounds, case_id="case_id", _round="round_no").withColumn(
        "_round", F.col("_round").cast("bigint")).withColumn("_round_ok", F.lit(True))
    by_run = found(runs, case_id="case_id", _ref="run_id").withColumn("_run_ok", F.lit(True))
    lines = numbered.where(F.col("_line").isNotNull()).select("case_id", "_source", "_line").distinct()
    noted = cut_lineage(lines.join(sources.select(
        "case_id", F.col("source_id").alias("_source")), ["case_id", "_source"]))
    by_line = (events.select(F.col("source_id").alias("_source"), F.col("line_no").alias("_line"))
               .join(broadcast_if_small(noted, 300), ["_source", "_line"])
               .distinct().withColumn("_line_ok", F.lit(True)))
    kind = F.col("anchor_kind")
    joined = (numbered.join(by_hit, ["case_id", "_ref"], "left")
              .join(by_round, ["case_id", "_round"], "left")
              .join(by_run, ["case_id", "_ref"], "left")
              .join(by_line, ["case_id", "_source", "_line"], "left"))
    missing = F.coalesce(
        F.when(kind == "hit", F.col("_hit_ok")), F.when(kind == "scan_round", F.col("_round_ok")),
        F.when(kind == "analysis_run", F.col("_run_ok")),
        F.when(kind == "line", F.col("_line_ok"))).isNull()
    text = F.trim("body")
    problem = (
        F.when(text.isNull() | (text == ""), "empty note")
        .when(F.length(text) > NOTE_MAX_CHARS, "note too long")
        .when(kind.isNull(), None)
        .when(~kind.isin("hit", "scan_round", "analysis_run", "line"), "unknown anchor kind")
        .when(F.coalesce("_ref", F.lit("")) == "", "anchor reference missing")
        .when(missing, "anchor does not exist"))
    return joined.select(*notes.columns, problem.alias("problem"))
