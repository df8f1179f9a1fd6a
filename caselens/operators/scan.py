"""A scan: all rules over all events, budgets, and the merge into stored hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed_values
from ..functions.columns import iso
from ..rules import CROSS_SOURCE_RULE, TIME_OPERATORS, builtin_rules, hit_cap, select_rules
from ..schema import HIT_KEY, HITS, flatten
from ..session import broadcast_if_small, cut_lineage, delete_folder, escape_partition
from .cross_source import cross_source_entities
from .hunts import cross_key_same_value, rate_spike, same_key_divergence, size_outlier
from .linkage import attach_linkage, entity_linkage
from .motifs import periodicity, sequence_motif
from .retrieve import ts_coverage
from .signatures import SNIPPET_CHARS, signature_scan

CANDIDATE = ["source_id", "line_no", "rule_id", "severity", "matched_field", "matched_value",
             "snippet", "ts_utc", "detail"]


def _key_text(keys: list[str]) -> Column:
    return F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in keys])


def _group(keys: list[str]) -> Column:
    return F.struct(*[F.col(k).alias(k) for k in keys]).alias("group")


def _clip(text: Column) -> Column:
    return F.substring(text, 1, SNIPPET_CHARS)


def _candidate(found: DataFrame, rule: dict, field: Column, value: Column, snippet: Column,
               ts: Column, kind: str, detail: list[Column]) -> DataFrame:
    return found.select(
        "source_id", "line_no", F.lit(rule["id"]).alias("rule_id"),
        F.lit(rule["severity"]).alias("severity"), field.alias("matched_field"),
        value.alias("matched_value"), snippet.alias("snippet"),
        ts.cast("timestamp").alias("ts_utc"),
        F.to_json(F.struct(F.lit(kind).alias("kind"), *detail,
                           F.col("line_no").alias("rep_line_no"))).alias("detail"))


def _divergence(events: DataFrame, rule: dict) -> DataFrame:
    keys, field, metric = rule["key_fields"], rule["diverge_field"], rule["metric"]
    found = same_key_divergence(
        flatten(events, [*keys, field, metric]), keys, field, metric,
        rule["min_group_events"], rule["diverge_ratio"])
    endless = F.isnan("ratio") | (F.col("ratio") == float("inf"))
    shown = F.when(endless, F.lit("×∞")).otherwise(F.format_string("×%.1f", "ratio"))
    return _candidate(
        found, rule, F.lit(field), shown,
        F.concat(F.lit("differs, to be reviewed: "), _key_text(keys),
                 F.lit(f"; mean {metric} by {field} "), shown),
        F.lit(None), "divergence",
        [_group(keys), F.lit(field).alias("diverge_field"), F.lit(metric).alias("metric"),
         F.when(~endless, F.round("ratio", 3)).alias("ratio"),
         F.col("group_events"), F.col("values")])


def _cluster(events: DataFrame, rule: dict, exclusions: dict | None = None) -> DataFrame:
    keys, field = rule["key_fields"], rule["value_field"]
    found = cross_key_same_value(
        flatten(events, [*keys, field]), field, keys, rule["min_keys"], rule["max_value_freq"],
        (exclusions or fixed_values.EXCLUSIONS).get(rule.get("exclude_kb"), []))
    return _candidate(
        found, rule, F.lit(field), _clip(F.col(field)),
        F.concat(F.lit("possible common origin, weak signal: "), F.lit(f"{field}="), F.col(field),
                 F.lit(" under "), F.col("distinct_keys").cast("string"), F.lit(" keys")),
        F.col("first_ts"), "cluster",
        [F.col(field).alias("value"), F.col("distinct_keys"), F.col("total_freq"),
         iso(F.col("first_ts")).alias("first_ts"), iso(F.col("last_ts")).alias("last_ts")])


def _spike(events: DataFrame, rule: dict) -> DataFrame:
    keys = rule["key_fields"]
    found = rate_spike(flatten(events, keys), keys, rule["bucket_seconds"], rule["zscore"],
                       rule["min_bucket_count"])
    start = F.timestamp_seconds("bucket")
    return _candidate(
        found, rule, F.lit(",".join(keys)),
        _clip(F.concat_ws(" ", *[F.col(k).cast("string") for k in keys])),
        F.concat(F.lit("rate spike, to be reviewed: "), _key_text(keys), F.lit(" at "), iso(start),
                 F.format_string(", %d events, z=%.1f", "count", "z")),
        start, "rate_spike",
        [_group(keys), iso(start).alias("bucket_start"),
         F.lit(rule["bucket_seconds"]).alias("bucket_seconds"), F.col("count"),
         F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"),
         F.round("z", 3).alias("z")])


def _outlier(events: DataFrame, rule: dict) -> DataFrame:
    keys, metric = rule["key_fields"], rule["metric"]
    found = size_outlier(flatten(events, [*keys, metric]), keys, metric, rule["min_group_events"],
                         rule["deviate_ratio"], rule["max_outliers"])
    direction = F.when(F.col("value") > F.col("median"), "large").otherwise("small")
    return _candidate(
        found, rule, F.lit(",".join(keys)), _clip(_key_text(keys)),
        F.concat(F.lit("size outlier, to be reviewed: "), _key_text(keys), F.format_string(
            "; median %.0f of %d, this one %.0f", "median", "group_events", "value")),
        F.col("ts"), "size_outlier",
        [_group(keys), F.col("line_no").alias("line"), F.col("value"), F.col("median"),
         F.col("group_events").alias("group_count"), direction.alias("direction"),
         F.lit(rule["deviate_ratio"]).alias("deviate_ratio")])


def _sequence(events: DataFrame, rule: dict) -> DataFrame:
    keys, steps = rule["key_fields"], rule["steps"]
    found = sequence_motif(flatten(events, [*keys, *[s["field"] for s in steps]]), keys, steps,
                           rule["window_seconds"], rule["min_first_step_count"])
    chain = " → ".join(f"{s['field']} in [{','.join(s['in'])}]" for s in steps)
    step_list = F.array(*[F.struct(
        F.lit(s["field"]).alias("field"),
        F.array(*[F.lit(v) for v in s["in"]]).alias("in")) for s in steps])
    return _candidate(
        found, rule, F.lit(",".join(keys)), _clip(_key_text(keys)),
        F.concat(F.lit("chain, to be reviewed: "), _key_text(keys), F.lit(f"; {chain}; first step ×"),
                 F.col("first_step_count").cast("string")),
        F.col("final_ts"), "sequence",
        [_group(keys), step_list.alias("steps"), F.col("first_step_count"),
         F.lit(rule["window_seconds"]).alias("window_seconds"),
         iso(F.col("first_step_last_ts")).alias("first_step_last_ts"),
         iso(F.col("final_ts")).alias("final_ts"), F.col("chain_lines").alias("chain_line_nos")])


def _periodic(events: DataFrame, rule: dict) -> DataFrame:
    keys = rule["key_fields"]
    found = periodicity(flatten(events, keys), keys, rule["min_events"], rule["max_cv"],
                        rule["min_span_seconds"])
    return _candidate(
        found, rule, F.lit(",".join(keys)), _clip(_key_text(keys)),
        F.concat(F.lit("regular intervals, to be reviewed: "), _key_text(keys), F.format_string(
            "; %d events, mean gap %.0fs, cv=%.3f", "events", "interval_mean", "cv")),
        F.col("first_ts"), "periodicity",
        [_group(keys), F.col("events"), F.round("span_seconds", 3).alias("span_seconds"),
         F.round("interval_mean", 3).alias("interval_mean"), F.round("cv", 4).alias("cv"),
         F.lit(rule["max_cv"]).alias("max_cv"),
         F.lit(rule["min_span_seconds"]).alias("min_span_seconds")])


_HUNTS = {
    "same_key_divergence": _divergence, "cross_key_same_value": _cluster, "rate_spike": _spike,
    "size_outlier": _outlier, "sequence": _sequence, "periodicity": _periodic,
}


def stat_candidates(events: DataFrame, rules: list[dict],
                    exclusions: dict | None = None) -> list[DataFrame]:
    return [_cluster(events, r, exclusions) if r["operator"] == "cross_key_same_value"
            else _HUNTS[r["operator"]](events, r) for r in rules]


def cross_source_candidates(entities: DataFrame, sources: DataFrame) -> DataFrame:
    """One hit per involved source, with the linkage score of its line."""
    found = cross_source_entities(entities, sources)
    scored = attach_linkage(found, entity_linkage(entities))
    return _candidate(
        scored, CROSS_SOURCE_RULE, F.lit("canonical_key"), F.col("canonical_key"),
        F.concat(F.lit("entity in several sources, to be reviewed: "), F.col("canonical_key"),
                 F.lit(" in "), F.col("source_count").cast("string"), F.lit(" sources")),
        F.col("first_ts"), "cross_source",
        [F.col("canonical_key").alias("value"), F.col("entity_type"), F.col("source_count"),
         F.col("linkage_score")])


def skipped_sources(events: DataFrame, rules: list[dict]) -> DataFrame:
    """Sources without any known time, listed for every rule that needs time."""
    timed = [r["id"] for r in rules if r["operator"] in TIME_OPERATORS]
    bare = ts_coverage(events).where(F.col("with_ts") == 0).select("source_id")
    ids = F.array(*[F.lit(i) for i in timed]) if timed else F.array().cast("array<string>")
    return bare.select(F.explode(ids).alias("rule_id"), "source_id",
                       F.lit("no event has a known time").alias("reason"))


def apply_budget(candidates: DataFrame, caps: dict[str, int],
                 order: tuple[str, ...] = ("source_id", "line_no")) -> DataFrame:
    """The first hits of each rule up to its cap; rules without a cap keep all.

    For callers that ask for the first hits. The literal bound of the filter lets every
    task drop rows beyond the largest cap before the shuffle.
    """
    free = candidates.where(~F.col("rule_id").isin(list(caps)))
    capped = candidates.where(F.col("rule_id").isin(list(caps)))
    if not caps:
        return candidates
    cap = F.element_at(F.create_map(*[F.lit(x) for p in caps.items() for x in p]), F.col("rule_id"))
    rank = F.row_number().over(Window.partitionBy("rule_id").orderBy(*order))
    kept = (capped.withColumn("_n", rank).where(F.col("_n") <= max(caps.values()))
            .where(F.col("_n") <= cap).drop("_n"))
    return kept.unionByName(free)


def mark_budget(candidates: DataFrame, caps: dict[str, int]) -> DataFrame:
    """All candidates with ``within_budget``: whether a rule's cap reaches as far.

    The budget orders what is read first; it removes nothing. The last hit inside the cap
    of each rule is found by a bounded top-k and compared with every candidate.
    """
    place = F.struct("source_id", "line_no")
    edge = apply_budget(candidates.where(F.col("rule_id").isin(list(caps))), caps).groupBy(
        F.col("rule_id").alias("_rule")).agg(F.max(place).alias("_edge"))
    # One row per rule.
    return candidates.join(F.broadcast(edge), F.col("rule_id") == F.col("_rule"), "left").withColumn(
        "within_budget", F.col("_edge").isNull() | (place <= F.col("_edge"))).drop("_rule", "_edge")


def budget_report(candidates: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Per rule: hits within the budget (duplicates included) and truncated ones.

    Every configured rule is listed, also without a hit.
    """
    spark = candidates.sparkSession
    rows = [(rule, cap) for rule, cap in caps.items()]
    listed = spark.createDataFrame(rows, "rule_id string, cap long")
    counted = candidates.groupBy("rule_id").agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    return listed.join(counted, "rule_id", "left").select(
        "rule_id", F.least(n, "cap").alias("hits"),
        F.greatest(n - F.col("cap"), F.lit(0)).alias("truncated"))


def merge_hits(candidates: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Candidates that are new: one per source, line and rule, none that is stored."""
    order = [c for c in candidates.columns if c not in HIT_KEY]
    # Rows of one key are few; the smallest one is kept so that a rerun keeps the same.
    unique = candidates.groupBy(*HIT_KEY).agg(F.min(F.struct(*order)).alias("_h")).select(
        *HIT_KEY, "_h.*")
    if stored is None:
        return unique
    return unique.join(stored.select(*HIT_KEY), HIT_KEY, "left_anti")


def next_round(rounds: DataFrame, case_id: str) -> int:
    row = rounds.where(F.col("case_id") == case_id).agg(F.max("round_no")).first()
    return (row[0] or 0) + 1


def list_rounds(rounds: DataFrame, case_id: str) -> DataFrame:
    return rounds.where(F.col("case_id") == case_id).orderBy("round_no")


def run_scan(events: DataFrame, entities: DataFrame, sources: DataFrame, case_id: str,
             signatures: list[dict] | None = None, stats: list[dict] | None = None,
             stored: DataFrame | None = None, rule_ids: list[str] | None = None,
             source_id: str | None = None, round_no: int = 1,
             exclusions: dict | None = None) -> dict[str, DataFrame]:
    """One scan of a case: ``hits`` to append, ``report`` per rule, ``skipped`` sources,
    ``summary``.

    Every hit is returned; ``within_budget`` marks those inside the cap of their rule.
    Unknown rule ids, a case without sources and a source of another case stop the scan before
    anything runs.
    """
    if signatures is None or stats is None:
        builtin = builtin_rules()
        signatures = builtin[0] if signatures is None else signatures
        stats = builtin[1] if stats is None else stats
    signatures, stats, with_cross = select_rules(signatures, stats, rule_ids)
    scope = sources.where(F.col("case_id") == case_id)
    if scope.isEmpty():
        raise ValueError(f"no case {case_id!r}")
    if source_id is not None:
        scope = scope.where(F.col("source_id") == source_id)
        if scope.isEmpty():
            raise ValueError(f"source {source_id!r} is not of case {case_id!r}")
    # The source list is materialised and counted, so that joining it moves no event.
    scope = broadcast_if_small(cut_lineage(scope.select("source_id", "log_type")), 200)
    in_scope = lambda df: df.join(scope.select("source_id"), "source_id", "left_semi")
    events, entities = in_scope(events), in_scope(entities)

    parts = [df.select(*CANDIDATE) for df in stat_candidates(events, stats, exclusions)]
    if signatures:
        parts.append(signature_scan(events, scope, signatures).withColumn(
            "detail", F.lit(None).cast("string")).select(*CANDIDATE))
    if with_cross:
        parts.append(cross_source_candidates(entities, scope).select(*CANDIDATE))
    if not parts:
        raise ValueError("no rule selected")
    # Counted, budgeted and merged from one evaluation.
    candidates = cut_lineage(reduce(DataFrame.unionByName, parts))
    caps = {r["id"]: hit_cap(r) for r in [*signatures, *stats]}
    fresh = merge_hits(mark_budget(candidates, caps), stored)
    hits = fresh.select(
        F.lit(case_id).alias("case_id"), "source_id", "line_no", "rule_id", "severity",
        "matched_field", "matched_value", "snippet", "ts_utc", F.lit("pending").alias("status"),
        "detail", F.lit(round_no).alias("round_no"), "within_budget").select(*HITS.fieldNames())
    report = budget_report(candidates, caps)
    tally = lambda df, name, value: df.agg(value.alias("value")).select(
        F.lit(name).alias("measure"), "value")
    one = F.count(F.lit(1))
    summary = (tally(events, "scanned", one).unionByName(tally(hits, "hits_new", one))
               .unionByName(tally(report, "truncated", F.coalesce(F.sum("truncated"), F.lit(0)))))
    return {"hits": hits, "report": report, "summary": summary,
            "skipped": skipped_sources(events, stats)}


def append_hits(hits: DataFrame, path: str, case_id: str | None = None,
                round_no: int | None = None) -> None:
    """Store rounds, each in the partition of its case and number.

    Rounds count per case, so both columns name a partition. A failed round is written
    again as a whole; ``case_id`` and ``round_no`` name the round that is written, so that
    its old rows go also when it has no hits any more.
    """
    (hits.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("case_id", "round_no").parquet(path))
    if case_id is not None and round_no is not None and hits.isEmpty():
        delete_folder(hits.sparkSession, f"{path}/case_id={escape_partition(case_id)}/"
                                         f"round_no={int(round_no)}")


def stored_hits(spark: SparkSession, path: str) -> DataFrame:
    """Stored hits with the types they were written with, whatever their ids look like."""
    return spark.read.schema(HITS).parquet(path).select(*HITS.fieldNames())
