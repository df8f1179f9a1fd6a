"""Custody checks: the audit hash chain and the export manifest of a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import new_folder
from .ordered import carry_forward

# Start of the chain and the order of hashed columns.
GENESIS = "GENESIS"
HASHED = ["id", "case_id", "ts", "actor", "action", "scope", "detail_json", "prev_hash"]


def entry_hash() -> Column:
    """SHA-256 over the entry's columns joined by '|', NULL as empty text."""
    return F.sha2(F.concat_ws("|", *[
        F.coalesce(F.col(c).cast("string"), F.lit("")) for c in HASHED]), 256)


def chain_checks(audit_log: DataFrame) -> DataFrame:
    """Every entry with its first failed check (duplicate, gap, link, hash) or NULL.

    A missing hash is a failed check, and so is an id that is missing or occurs twice.

    The predecessor of an entry is found by its id, so the chain is checked by one
    equi-join instead of one global sort.
    """
    before = audit_log.groupBy((F.col("id") + 1).alias("id")).agg(
        F.min("entry_hash").alias("_prev"), F.lit(True).alias("_there"))
    copies = audit_log.groupBy("id").agg(F.count(F.lit(1)).alias("_copies"))
    first = F.col("id") == 1
    failure = (
        F.when(F.col("_copies").isNull() | (F.col("_copies") > 1), "duplicate")
        .when(~first & F.col("_there").isNull(), "gap")
        .when(~F.col("prev_hash").eqNullSafe(
            F.when(first, F.lit(GENESIS)).otherwise(F.col("_prev"))), "link")
        .when(F.col("prev_hash").isNull(), "link")
        .when(~F.col("entry_hash").eqNullSafe(entry_hash()), "hash"))
    return audit_log.join(before, "id", "left").join(copies, "id", "left").withColumn(
        "failure", failure).drop("_prev", "_there", "_copies")


def verify_chain(audit_log: DataFrame) -> DataFrame:
    """One row: ok, entries, and the first failing id with its kind."""
    failed = F.col("failure").isNotNull()
    return chain_checks(audit_log).agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(failed).alias("_failed"),
        F.min(F.when(failed, F.struct("id", "failure"))).alias("_first"),
    ).select((F.col("_failed") == 0).alias("ok"), "entries",
             F.col("_first.id").alias("first_bad_id"), F.col("_first.failure").alias("failure"))


def manifest_sources(sources: DataFrame, events: DataFrame, inventory: DataFrame) -> DataFrame:
    """Per source: registered facts, number of events and whether its file is there.

    ``sources`` has ``path``; ``inventory`` lists the files that exist.
    """
    counts = events.groupBy("source_id").agg(F.count(F.lit(1)).alias("events"))
    present = inventory.select("path", F.lit(True).alias("_there")).distinct()
    return (sources.join(counts, "source_id", "left").join(present, "path", "left")
            .withColumn("missing", F.col("_there").isNull()).drop("_there"))


def manifest_audit(audit_log: DataFrame) -> DataFrame:
    """Per case: number of chain entries and the last hash."""
    return audit_log.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("count"), F.max_by("entry_hash", "id").alias("last_hash"))


def case_manifest(cases: DataFrame, sources: DataFrame, events: DataFrame,
                  inventory: DataFrame, audit_log: DataFrame) -> dict[str, DataFrame]:
    """The manifest of each case as tables: cases with their audit summary, and sources."""
    listed = manifest_sources(sources, events, inventory)
    tallies = listed.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("sources"),
        F.count_if(~F.col("missing")).alias("files_copied"),
        F.count_if("missing").alias("files_missing"))
    head = (cases.join(tallies, "case_id", "left").join(manifest_audit(audit_log), "case_id", "left")
            .na.fill(0, ["sources", "files_copied", "files_missing", "count"]))
    return {"cases": head, "sources": listed,
            "audit_chain": audit_log.join(cases.select("case_id"), "case_id", "left_semi")}


def write_manifest(manifest: dict[str, DataFrame], folder: str | None = None) -> str:
    """Write the manifest tables as JSON directories; returns the folder."""
    spark = manifest["cases"].sparkSession
    folder = folder or new_folder(spark, "manifest")
    for name, table in manifest.items():
        table.write.mode("errorifexists").json(f"{folder}/{name}")
    return folder


def verify_manifest(cases: DataFrame, sources: DataFrame, audit_log: DataFrame,
                    inventory: DataFrame) -> DataFrame:
    """Checks of an export: case_id, check, ok, detail.

    ``cases`` carries the recorded audit count and last hash; ``inventory`` has the actual
    hashes. Links that point outside the export are counted and are no failure.
    """
    entry = audit_log.withColumn("_bad", ~F.col("entry_hash").eqNullSafe(entry_hash()))
    # The exported predecessor of an entry is the entry before it in its own case.
    linked = carry_forward(entry, ["case_id"], "id", F.col("entry_hash"), "_before",
                           strict=True).withColumn(
        "_outside", ~F.col("prev_hash").eqNullSafe(F.coalesce("_before", F.lit(GENESIS))))
    chain = linked.groupBy("case_id").agg(
        F.count_if("_bad").alias("_bad"), F.count_if("_outside").alias("_external"),
        F.count(F.lit(1)).alias("_entries"), F.max_by("entry_hash", "id").alias("_last"))
    facts = cases.join(chain, "case_id", "left").na.fill(0, ["_bad", "_external", "_entries"])
    check = lambda name, ok, detail: F.struct(
        F.lit(name).alias("check"), ok.alias("ok"), detail.alias("detail"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    of_case = facts.select("case_id", F.explode(F.array(
        check("entry_hash", F.col("_bad") == 0, F.concat(text("_bad"), F.lit(" altered"))),
        check("chain_link", F.lit(True), F.concat(text("_external"), F.lit(" external"))),
        check("count", F.col("count") == F.col("_entries"),
              F.concat(text("count"), F.lit(" recorded, "), text("_entries"), F.lit(" found"))),
        check("last_hash", F.col("last_hash").eqNullSafe(F.col("_last")),
              F.concat(text("last_hash"), F.lit(" recorded, "), text("_last"), F.lit(" found"))),
    )).alias("c")).select("case_id", "c.*")
    actual = inventory.select("path", F.col("sha256").alias("_actual"))
    of_file = sources.join(actual, "path", "left").select(
        "case_id", F.concat(F.lit("file:"), F.coalesce("name", "path")).alias("check"),
        F.coalesce(F.col("_actual") == F.col("sha256"), F.lit(False)).alias("ok"),
        F.when(F.col("_actual").isNull(), "missing").when(
            F.col("_actual") == F.col("sha256"), "same").otherwise("altered").alias("detail"))
    return of_case.unionByName(of_file)
