"""Scan rounds of a case: hits are written first, one ledger row publishes them."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..rules import builtin_rules, draft_ids, load_rules, select_rules, unique_rules
from ..schema import HITS
from ..session import broadcast_if_small, cut_lineage, path_exists
from .scan import append_hits, next_round, run_scan, stored_hits

ROUNDS = T.StructType([
    T.StructField("case_id", T.StringType()),
    T.StructField("round_no", T.IntegerType()),
    T.StructField("rule_ids", T.StringType()),        # JSON list, NULL = all rules
    T.StructField("rule_count", T.IntegerType()),     # NULL = all rules
    T.StructField("actor", T.StringType()),
    T.StructField("scanned", T.LongType()),
    T.StructField("hits_new", T.LongType()),
    T.StructField("hits_total", T.LongType()),
    T.StructField("truncated", T.LongType()),
    T.StructField("signature_new", T.LongType()),
    T.StructField("stats_new", T.LongType()),
    T.StructField("cross_source_new", T.LongType()),
    T.StructField("created_at", T.TimestampType()),
])


def published_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger: one row per round that ended, in any order."""
    path = f"{folder}/rounds"
    return spark.read.schema(ROUNDS).parquet(path) if path_exists(spark, path) else (
        spark.createDataFrame([], ROUNDS))


def published_hits(spark: SparkSession, folder: str, case_id: str | None = None) -> DataFrame:
    """Hits of published rounds; what a round left that failed or still runs is not seen."""
    path = f"{folder}/hits"
    if not path_exists(spark, path):
        return spark.createDataFrame([], HITS)
    rounds = published_rounds(spark, folder)
    hits = stored_hits(spark, path)
    if case_id is not None:
        rounds, hits = (df.where(F.col("case_id") == case_id) for df in (rounds, hits))
    # The ledger has one row per scan.
    seen = broadcast_if_small(cut_lineage(rounds.select("case_id", "round_no").distinct()), 200)
    return hits.join(seen, ["case_id", "round_no"], "left_semi").select(*HITS.fieldNames())


def case_rules(folder: str | None = None, exclusions: dict | None = None) -> tuple[list, list, set]:
    """Built-in rules and the enabled ones of ``folder``, and the ids of its other rules."""
    signatures, stats = builtin_rules()
    if folder is None:
        return signatures, stats, set()
    own_signatures, own_stats = load_rules(folder, exclusions)
    signatures, stats = signatures + own_signatures, stats + own_stats
    unique_rules(signatures + stats)
    return signatures, stats, draft_ids(folder)


def scan_case(events: DataFrame, entities: DataFrame, sources: DataFrame, folder: str, case_id: str,
              rule_ids: list[str] | None = None, source_id: str | None = None,
              actor: str = "system", signatures: list[dict] | None = None,
              stats: list[dict] | None = None, rules_folder: str | None = None,
              exclusions: dict | None = None) -> dict[str, DataFrame]:
    """Scan a case as its next round and publish the round in ``folder``.

    Returns what ``run_scan`` returns, with ``hits`` read from the stored round, and ``round``,
    its ledger row. Without ``signatures`` and ``stats`` the built-in rules run, and the enabled
    ones of ``rules_folder``. An unknown case, a source of another case, an unknown rule and a
    selected rule that is not enabled are errors, and nothing is written. A round that fails
    before its ledger row is written has no number: the next one takes it and replaces its rows.
    """
    spark, drafts = events.sparkSession, set()
    if signatures is None and stats is None:
        signatures, stats, drafts = case_rules(rules_folder, exclusions)
    signatures, stats = signatures or [], stats or []
    own_signatures, own_stats, _ = select_rules(signatures, stats, rule_ids, drafts)
    before = published_hits(spark, folder, case_id)
    number = next_round(published_rounds(spark, folder), case_id)
    scan = run_scan(events, entities, sources, case_id, signatures, stats, before, rule_ids,
                    source_id, number, exclusions)
    append_hits(scan["hits"], f"{folder}/hits", case_id, number)
    written = stored_hits(spark, f"{folder}/hits").where(
        (F.col("case_id") == case_id) & (F.col("round_no") == number))
    by_kind = lambda rules: F.count_if(F.col("rule_id").isin([r["id"] for r in rules]))
    new, of_signatures, of_stats = written.agg(
        F.count(F.lit(1)), by_kind(own_signatures), by_kind(own_stats)).first()
    summary = {r["measure"]: r["value"] for r in scan["summary"].where(
        "measure <> 'hits_new'").collect()}
    row = (case_id, number, None if rule_ids is None else json.dumps(sorted(set(rule_ids))),
           None if rule_ids is None else len(set(rule_ids)), actor, summary["scanned"], new,
           before.count() + new, summary["truncated"], of_signatures, of_stats,
           new - of_signatures - of_stats, datetime.now(timezone.utc))
    ledger = spark.createDataFrame([row], ROUNDS)
    ledger.coalesce(1).write.mode("append").parquet(f"{folder}/rounds")
    return {**scan, "hits": written, "round": ledger}
