"""Order in time within a key: event series, chains and regular intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import GROUP_ROWS_PER_TASK, join_group_facts, not_null


def event_series(df: DataFrame, keys: list[str], ts: str = "ts_utc", line: str = "line_no",
                 source: str = "source_id") -> DataFrame:
    """Events in the order source, key, time, line; without time or key they are left out.

    A global sort range-partitions on all four, so one huge key spreads over many tasks.
    """
    return df.where(not_null([*keys, ts])).orderBy(source, *keys, ts, line)


def _step_condition(step: dict) -> Column:
    return F.lower(F.col(step["field"]).cast("string")).isin(
        [str(v).lower() for v in step["in"]])


def sequence_motif(df: DataFrame, keys: list[str], steps: list[dict], window_seconds: int,
                   min_first: int = 3, source: str = "source_id", line: str = "line_no",
                   ts: str = "ts_utc", rows_per_task: int = GROUP_ROWS_PER_TASK) -> DataFrame:
    """Chains A→B(→C) per key: many first steps, then each next step within the window.

    The chain starts at the last first-step event of the key. Each later step is the
    earliest matching event after the previous one, found as a minimum over a join with one
    row per key; no key is sorted or held by one task.
    """
    if not 2 <= len(steps) <= 3:
        raise ValueError("a chain has two or three steps")
    group = [source, *keys]
    flags = [_step_condition(s) for s in steps]
    touched = (df.where(not_null([*keys, ts])).where(reduce(lambda a, b: a | b, flags))
               .select(*group, F.struct(F.col(ts).alias("ts"), F.col(line).alias("line")).alias("_at"),
                       *[f.alias(f"_s{i}") for i, f in enumerate(flags)]))
    chain = touched.groupBy(*group).agg(
        F.count_if("_s0").alias("first_step_count"),
        F.max(F.when(F.col("_s0"), F.col("_at"))).alias("_p0"),
        *[F.count_if(f"_s{i}").alias(f"_n{i}") for i in range(1, len(steps))],
    ).where(F.col("first_step_count") >= min_first)
    for i in range(1, len(steps)):
        chain = chain.where(F.col(f"_n{i}") > 0)
    for i in range(1, len(steps)):
        previous = F.col(f"_p{i - 1}")
        candidates = join_group_facts(
            touched.where(F.col(f"_s{i}")).select(*group, "_at"), chain, group,
            f"_n{i}", ["_at"], rows_per_task)
        limit = previous["ts"] + F.make_dt_interval(secs=F.lit(window_seconds))
        kept = [c for c in chain.columns if c not in group]
        chain = (candidates
                 .where((F.col("_at") > previous) & (F.col("_at")["ts"] <= limit))
                 .groupBy(*group)
                 .agg(F.min("_at").alias(f"_p{i}"), *[F.first(c).alias(c) for c in kept]))
    last = f"_p{len(steps) - 1}"
    return chain.select(
        *group, F.col(last)["line"].alias("line_no"), "first_step_count",
        F.col("_p0")["ts"].alias("first_step_last_ts"), F.col(last)["ts"].alias("final_ts"),
        F.array(*[F.col(f"_p{i}")["line"] for i in range(len(steps))]).alias("chain_lines"))


def periodicity(df: DataFrame, keys: list[str], min_events: int = 6, max_cv: float = 0.2,
                min_span_seconds: float = 300, source: str = "source_id",
                line: str = "line_no", ts: str = "ts_utc",
                rows_per_task: int = GROUP_ROWS_PER_TASK) -> DataFrame:
    """Keys whose events arrive at regular intervals (coefficient of variation of gaps).

    Rows are reduced to distinct times per key. The mean gap follows from first, last and
    count; only the squared deviations need neighbours. A key with very many times is cut
    into seconds: gaps inside a second are taken there, gaps between seconds over one row
    per second.
    """
    group = [source, *keys]
    micros = F.unix_micros(F.col(ts))
    times = (df.where(not_null([*keys, ts])).groupBy(*group, micros.alias("_t"))
             .agg(F.count(F.lit(1)).alias("_c"), F.min(line).alias("_line")))
    facts = times.groupBy(*group).agg(
        F.sum("_c").alias("events"), F.count(F.lit(1)).alias("_times"),
        F.min("_t").alias("_first"), F.max("_t").alias("_last"),
        F.min_by("_line", "_t").alias("line_no"))
    span = (F.col("_last") - F.col("_first")) / 1e6
    facts = (facts.withColumn("span_seconds", span)
             .where((F.col("events") >= min_events) & (F.col("span_seconds") >= min_span_seconds)
                    & (F.col("span_seconds") > 0))
             .withColumn("interval_mean", F.col("span_seconds") / (F.col("events") - 1)))
    second = F.when(F.col("_times") > rows_per_task, F.floor(F.col("_t") / 1_000_000)).otherwise(0)
    placed = join_group_facts(
        times.select(*group, "_t", "_c"),
        facts.select(*group, "_times", F.col("interval_mean").alias("_mean")),
        group, "_times", ["_t"], rows_per_task).withColumn("_cell", second)
    cell = [*group, "_cell"]
    gap = (F.col("_t") - F.lag("_t").over(Window.partitionBy(*cell).orderBy("_t"))) / 1e6
    deviation = lambda g: F.pow(g - F.col("_mean"), F.lit(2))
    inside = placed.withColumn("_dev", F.coalesce(deviation(gap), F.lit(0.0)) + (
        F.col("_c") - 1) * F.pow(F.col("_mean"), F.lit(2)))
    cells = inside.groupBy(*cell).agg(
        F.sum("_dev").alias("_dev"), F.min("_t").alias("_from"), F.max("_t").alias("_to"),
        F.first("_mean").alias("_mean"))
    between = (F.col("_from") - F.lag("_to").over(
        Window.partitionBy(*group).orderBy("_cell"))) / 1e6
    spread = cells.withColumn("_dev", F.col("_dev") + F.coalesce(
        deviation(between), F.lit(0.0))).groupBy(*group).agg(F.sum("_dev").alias("_dev"))
    cv = F.sqrt(F.col("_dev") / (F.col("events") - 1)) / F.col("interval_mean")
    return (facts.join(spread, group).withColumn("cv", cv).where(F.col("cv") <= max_cv)
            .select(*group, "line_no", "events", "span_seconds", "interval_mean", "cv",
                    F.timestamp_micros("_first").alias("first_ts")))
