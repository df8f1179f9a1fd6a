"""How strongly events hang together through rare shared entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage

DAMPING = 0.85
ROUNDS = 20
CHECKPOINT_EVERY = 5
# Entity-event pairs of one task, some 40 bytes each.
PAIRS_PER_TASK = 1_000_000


def incidence(entities: DataFrame, max_entities: int | None = None,
              max_df: int | None = None) -> DataFrame:
    """Entity-event pairs of shared entities: key, event, ln(1 + frequency), 1 / df.

    All entities of two or more events take part. A caller who asks for less names the
    largest df, or the number of rarest entities.
    """
    # Most keys occur once; they go before anything is grouped by event.
    often = entities.groupBy("canonical_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    pairs = entities.join(often.select("canonical_key"), "canonical_key", "left_semi").groupBy(
        "canonical_key", "source_id", "line_no").agg(F.count(F.lit(1)).alias("_freq"))
    shared = pairs.groupBy("canonical_key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    if max_df is not None:
        shared = shared.where(F.col("df") <= max_df)
    if max_entities is not None:
        shared = shared.orderBy("df", "canonical_key").limit(max_entities)
    return pairs.join(shared, "canonical_key").select(
        "canonical_key", "source_id", "line_no",
        F.log1p(F.col("_freq").cast("double")).alias("l"), (F.lit(1.0) / F.col("df")).alias("w"))


def _to_events(sums: DataFrame) -> DataFrame:
    """One row per entity, made once and broadcast while its measured size allows it."""
    return broadcast_if_small(cut_lineage(sums), 50)


def entity_linkage(entities: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS,
                   max_entities: int | None = None, max_df: int | None = None) -> DataFrame:
    """Weighted PageRank over events that share an entity: source_id, line_no, score.

    An edge between two events of entity k weighs (1/df) * ln(1 + frequency at its end).
    Edges are never listed: what an event receives through k is the sum over all events of
    k minus its own part. A round is a sum per entity and a sum per event, both combined
    before they are shuffled, so an entity of any number of events is no single task.
    """
    spark, event = entities.sparkSession, ["source_id", "line_no"]
    pairs = cut_lineage(incidence(entities, max_entities, max_df))
    # Rounds run on two integers instead of texts; the ids are fixed by the checkpoints.
    events = cut_lineage(pairs.select(*event).distinct().withColumn(
        "_e", F.monotonically_increasing_id()))
    keys = cut_lineage(pairs.select("canonical_key").distinct().withColumn(
        "_k", F.monotonically_increasing_id()))
    base = cut_lineage(pairs.join(keys, "canonical_key").join(events, event).select(
        "_k", "_e", "l", "w"))
    nodes = max(events.count(), 1)
    # Kept by event over all rounds, so that sums per event move no row. Sums per entity are
    # one small row each; they go to the events, not the events to them.
    parts = max(spark.sparkContext.defaultParallelism, -(-base.count() // PAIRS_PER_TASK))
    of_key = base.groupBy("_k").agg(F.sum("l").alias("_s"))
    base = base.repartition(parts, "_e").sortWithinPartitions("_e").persist()
    state = base.join(_to_events(of_key), "_k").groupBy("_e").agg(
        F.sum(F.col("w") * (F.col("_s") - F.col("l"))).alias("out"),
        F.sum(F.col("w") * F.col("l")).alias("own")).withColumn("score", F.lit(1.0 / nodes)).persist()
    # An event without outgoing weight passes nothing on.
    share = F.when(F.col("out") > 0, F.col("score") / F.col("out")).otherwise(F.lit(0.0))
    for round_no in range(1, rounds + 1):
        passed = _to_events(base.join(state.select("_e", share.alias("_share")), "_e").groupBy("_k").agg(
            F.sum("_share").alias("_t")))
        received = base.join(passed, "_k").groupBy("_e").agg(
            F.sum(F.col("w") * F.col("l") * F.col("_t")).alias("_in"))
        before, state = state, state.join(received, "_e").select("_e", "out", "own", (
            F.lit((1.0 - damping) / nodes)
            + F.lit(damping) * (F.col("_in") - share * F.col("own"))).alias("score"))
        if round_no % CHECKPOINT_EVERY == 0 or round_no == rounds:
            state = cut_lineage(state)
        else:
            # The round is held before the one it came from is let go.
            state = state.persist()
            state.count()
        before.unpersist()
    base.unpersist()
    return events.join(state, "_e").select(*event, "score")


def attach_linkage(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """Hits with their rounded score, strongest first."""
    return (hits.join(scores.select("source_id", "line_no", F.col("score").alias("_score")),
                      ["source_id", "line_no"], "left")
            .withColumn("linkage_score", F.round(F.coalesce("_score", F.lit(0.0)), 6))
            .drop("_score")
            .orderBy(F.desc("linkage_score"), "line_no", "source_id"))
