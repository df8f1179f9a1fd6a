"""Human decisions on hits and the clues that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import HIT_KEY


def apply_reviews(hits: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their decision, refused decisions).

    ``reviews`` is append-only: the hit key, review_id, decided_at, decision
    (accepted | rejected), note, actor. The first decision on a pending hit counts; later
    ones, and decisions on hits that are not pending or do not exist, are refused.
    """
    order = F.struct("decided_at", "review_id")
    first = reviews.groupBy(*HIT_KEY).agg(F.min(F.struct(
        "decided_at", "review_id", "decision", "note", "actor")).alias("_r"))
    joined = hits.join(first, HIT_KEY, "left").withColumn(
        "_taken", (F.col("status") == "pending") & F.col("_r").isNotNull())
    decided = joined.select(
        *[c for c in hits.columns if c != "status"],
        F.when(F.col("_taken"), F.col("_r.decision")).otherwise(F.col("status")).alias("status"),
        F.when(F.col("_taken"), F.col("_r.decided_at")).alias("reviewed_at"),
        F.when(F.col("_taken"), F.col("_r.note")).alias("review_note"),
        F.when(F.col("_taken"), F.col("_r.actor")).alias("reviewer"))
    facts = joined.select(*HIT_KEY, F.col("status").alias("_status"), "_taken",
                          F.struct("_r.decided_at", "_r.review_id").alias("_first"))
    refused = (reviews.join(facts, HIT_KEY, "left")
               .where(F.col("_status").isNull() | ~F.col("_taken") | (order != F.col("_first")))
               .select(*reviews.columns, F.when(F.col("_status").isNull(), "no such hit")
                       .when(~F.col("_taken"), F.concat(F.lit("already "), F.col("_status")))
                       .otherwise("already decided").alias("refusal")))
    return decided, refused


def build_clues(decided: DataFrame, sources: DataFrame, titles: dict[str, str]) -> DataFrame:
    """Clues from accepted hits: title, text and anchor with the hash of the source.

    ``titles`` is the rule configuration; an unknown rule is titled by its id. A hit of a
    source that is not registered stays a clue, marked by ``source_missing``.
    """
    title = F.col("rule_id")
    if titles:
        names = F.create_map(*[F.lit(x) for pair in titles.items() for x in pair])
        title = F.coalesce(F.element_at(names, F.col("rule_id")), F.col("rule_id"))
    note = F.trim(F.col("review_note"))
    body = F.concat(
        F.format_string(
            "[rule hit] %s\nrule: %s (severity=%s)\nmatch: %s contains \"%s\"\ntext: %s\n"
            "anchor: source %s line %d sha256=%s",
            F.col("title"), "rule_id", "severity", "matched_field", "matched_value", "snippet",
            "source_id", "line_no", F.coalesce("sha256", F.lit("unknown"))),
        F.when(note != "", F.concat(F.lit("\nreview note: "), note)).otherwise(F.lit("")))
    return (decided.where(F.col("status") == "accepted")
            .join(sources.select("source_id", "sha256", F.lit(True).alias("_known")), "source_id",
                  "left")
            .withColumn("title", title)
            .select("case_id", "title", body.alias("body"), "source_id", "line_no", "sha256",
                    "rule_id", F.col("reviewed_at").alias("created_at"),
                    F.col("reviewer").alias("created_by"),
                    F.col("_known").isNull().alias("source_missing")))
