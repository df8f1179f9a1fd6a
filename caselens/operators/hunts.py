"""Statistical hunts over key groups; every hunt runs per source.

Groups may be badly uneven. Each hunt first reduces rows by a combinable aggregate, then
decides on the reduced table, and only goes back to rows for groups that qualify.
Column names are parameters, so the hunts run on any table with a line number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import any_token, bucket_start, number
from ..session import broadcast_if_small, cut_lineage
from .retrieve import top_k
from .skew import GROUP_ROWS_PER_TASK, join_group_facts, not_null

# Distinct values of a group that one sorted array may hold, bins of a refinement, and an
# upper bound of the bytes a group's keys take in a broadcast.
VALUES_AT_ONCE = 4096
MEDIAN_BINS = 32
_GROUP_BYTES = 512


def metric_value(df: DataFrame, metric: str) -> Column:
    """The metric as double: numeric columns as they are, text when it is a number."""
    kind = df.schema[metric].dataType.typeName() if metric in df.columns else "string"
    return number(F.col(metric)) if kind == "string" else F.col(metric).cast("double")


def divergence_cells(df: DataFrame, keys: list[str], diverge: str, metric: str,
                     source: str = "source_id", line: str = "line_no") -> DataFrame:
    """Per key group and value of ``diverge``: events, mean metric, first line."""
    return (df.where(not_null([*keys, diverge]))
            .groupBy(source, *keys, diverge).agg(
                F.count(F.lit(1)).alias("events"),
                F.avg(metric_value(df, metric)).alias("mean"),
                F.min(line).alias("first_line")))


def same_key_divergence(df: DataFrame, keys: list[str], diverge: str, metric: str,
                        min_group_events: int, diverge_ratio: float,
                        source: str = "source_id", line: str = "line_no") -> DataFrame:
    """Key groups whose mean metric differs strongly between values of ``diverge``.

    The evidence rows of a hit are ``divergence_cells``; they stay rows, because a group
    can have any number of them.
    """
    cells = divergence_cells(df, keys, diverge, metric, source, line)
    low, high = F.col("low_mean"), F.col("high_mean")
    groups = cells.groupBy(source, *keys).agg(
        F.sum("events").alias("group_events"),
        F.count("mean").alias("values"),
        F.min("mean").alias("low_mean"), F.max("mean").alias("high_mean"),
        F.min("first_line").alias("line_no"))
    return (groups
            .where((F.col("group_events") >= min_group_events) & (F.col("values") >= 2)
                   & (high > 0))
            .withColumn("ratio", F.when(low <= 0, F.lit(float("inf"))).otherwise(high / low))
            .where(F.col("ratio") >= diverge_ratio))


def cross_key_same_value(df: DataFrame, value: str, keys: list[str], min_keys: int,
                         max_value_freq: int, exclude: list[str] | None = None,
                         source: str = "source_id", line: str = "line_no",
                         ts: str | None = "ts_utc") -> DataFrame:
    """Rare values that occur under several distinct keys."""
    first = F.min(ts) if ts else F.min(F.lit(None).cast("timestamp"))
    last = F.max(ts) if ts else F.max(F.lit(None).cast("timestamp"))
    pairs = (df.where(not_null([value, *keys])).groupBy(source, value, *keys).agg(
        F.count(F.lit(1)).alias("_n"), first.alias("_first"), last.alias("_last"),
        F.min(line).alias("_line")))
    values = pairs.groupBy(source, value).agg(
        F.count(F.lit(1)).alias("distinct_keys"), F.sum("_n").alias("total_freq"),
        F.min("_first").alias("first_ts"), F.max("_last").alias("last_ts"),
        F.min("_line").alias("line_no"))
    return values.where(
        (F.col("distinct_keys") >= min_keys) & (F.col("total_freq") < max_value_freq)
        & ~any_token(F.col(value).cast("string"), exclude or []))


def rate_buckets(df: DataFrame, keys: list[str], bucket_seconds: int,
                 source: str = "source_id", line: str = "line_no",
                 ts: str = "ts_utc") -> DataFrame:
    """Events per key and time bucket; empty buckets do not exist."""
    return (df.where(not_null([*keys, ts]))
            .groupBy(source, *keys, bucket_start(F.col(ts), bucket_seconds).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("count"), F.min(line).alias("line_no")))


def rate_spike(df: DataFrame, keys: list[str], bucket_seconds: int, zscore: float,
               min_bucket_count: int, source: str = "source_id", line: str = "line_no",
               ts: str = "ts_utc", rows_per_task: int = GROUP_ROWS_PER_TASK) -> DataFrame:
    """Time buckets far above the mean of their own key (population deviation)."""
    buckets = rate_buckets(df, keys, bucket_seconds, source, line, ts)
    base = (buckets.groupBy(source, *keys).agg(
        F.avg("count").alias("mean"), F.stddev_pop("count").alias("std"),
        F.max("count").alias("_peak"), F.count(F.lit(1)).alias("_buckets"))
        # A key whose highest bucket does not qualify has no hit at all.
        .where((F.col("std") > 0) & (F.col("_peak") >= min_bucket_count)
               & ((F.col("_peak") - F.col("mean")) / F.col("std") >= zscore))
        .drop("_peak"))
    loud = buckets.where(F.col("count") >= min_bucket_count)
    return (join_group_facts(loud, base, [source, *keys], "_buckets", ["bucket"], rows_per_task)
            .withColumn("z", (F.col("count") - F.col("mean")) / F.col("std"))
            .where(F.col("z") >= zscore).drop("_buckets"))


def _at_rank(values: Column, rank: Column) -> Column:
    """The value at a rank (from 1) of sorted (value, count) pairs."""
    step = lambda acc, e: F.struct(
        (acc["seen"] + e["n"]).alias("seen"),
        F.when(acc["at"].isNull() & (acc["seen"] + e["n"] >= rank), e["value"]).otherwise(acc["at"]).alias("at"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("at"))
    return F.aggregate(values, start, step, lambda acc: acc["at"])


def _sorted_pairs(value: str, count: str) -> Column:
    return F.sort_array(F.collect_list(F.struct(
        F.col(value).cast("double").alias("value"), F.col(count).alias("n"))))


def select_ranks(weights: DataFrame, ranks: DataFrame, group: list[str], value: str, count: str,
                 most_values: int = VALUES_AT_ONCE) -> DataFrame:
    """The exact value at a rank inside each group, without ordering the group.

    ``weights``: distinct values of a group with their counts; ``ranks``: the group, a name
    ``which`` and ``rank`` (from 1). Approximate quantiles, a sketch that combines, cut the
    values of a group into bins; the counts of the bins tell in which one a rank lies, and only
    that bin goes on. When a rank has ``most_values`` values left, they are sorted as an array.
    """
    each = [*group, "which"]
    done = None
    rows = cut_lineage(weights.join(ranks, group).select(
        *each, "rank", F.col(value).cast("double").alias("_v"), F.col(count).alias("_n")))
    while True:
        sizes = cut_lineage(rows.groupBy(*each).agg(F.count(F.lit(1)).alias("_size")))
        small = broadcast_if_small(sizes.where(F.col("_size") <= most_values).select(*each), _GROUP_BYTES)
        ended = rows.join(small, each, "left_semi").groupBy(*each).agg(
            F.first("rank").alias("rank"), _sorted_pairs("_v", "_n").alias("_pairs")).select(
            *each, _at_rank(F.col("_pairs"), F.col("rank")).alias("at"))
        done = ended if done is None else done.unionByName(ended)
        large = sizes.where(F.col("_size") > most_values).select(*each)
        if large.isEmpty():
            return done
        rows = rows.join(broadcast_if_small(large, _GROUP_BYTES), each, "left_semi")
        cuts = cut_lineage(rows.groupBy(*each).agg(F.percentile_approx(
            "_v", [i / MEDIAN_BINS for i in range(1, MEDIAN_BINS)], 50 * MEDIAN_BINS).alias("_cuts")))
        binned = rows.join(broadcast_if_small(cuts, _GROUP_BYTES + 8 * MEDIAN_BINS), each).withColumn(
            "_bin", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).cast("long")).drop("_cuts")
        bins = binned.groupBy(*each, "rank", "_bin").agg(F.sum("_n").alias("_all")).groupBy(
            *each, "rank").agg(F.sort_array(F.collect_list(F.struct(
                F.col("_bin").alias("bin"), F.col("_all").alias("n")))).alias("_bins"))
        # At most MEDIAN_BINS entries: those before the bin with the rank, then that one.
        upto = lambda i: F.aggregate(F.slice("_bins", F.lit(1), i), F.lit(0).cast("long"),
                                     lambda acc, e: acc + e["n"])
        place = F.array_min(F.filter(F.sequence(F.lit(1), F.size("_bins")), lambda i: upto(i) >= F.col("rank")))
        chosen = cut_lineage(bins.withColumn("_place", place).select(
            *each, F.element_at("_bins", F.col("_place"))["bin"].alias("_bin"),
            (F.col("rank") - upto(F.col("_place") - 1)).alias("_rest")))
        rows = cut_lineage(binned.join(broadcast_if_small(chosen, _GROUP_BYTES + 16), [*each, "_bin"]).select(
            *each, F.col("_rest").alias("rank"), "_v", "_n"))


def group_medians(df: DataFrame, keys: list[str], value: str, source: str,
                  most_values: int = VALUES_AT_ONCE) -> DataFrame:
    """Exact interpolated median, extremes and size per group.

    Rows are first reduced to distinct values with their counts. Groups of few distinct values
    find their middle ranks in one sorted array; larger ones by ``select_ranks``, so no task
    sees all values of a group.
    """
    group = [source, *keys]
    weights = cut_lineage(df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c")))
    facts = cut_lineage(weights.groupBy(*group).agg(
        F.sum("_c").alias("group_events"), F.count(F.lit(1)).alias("_distinct"),
        F.min(value).alias("_min"), F.max(value).alias("_max")))
    lower = F.floor((F.col("group_events") + 1) / 2)
    upper = F.floor((F.col("group_events") + 2) / 2)
    middle = lambda low, high: (low + (high - low) * 0.5).alias("median")
    out = ["group_events", "_min", "_max"]
    large = facts.where(F.col("_distinct") > most_values)
    few = weights if large.isEmpty() else weights.join(
        broadcast_if_small(large.select(*group), _GROUP_BYTES), group, "left_anti")
    medians = few.groupBy(*group).agg(
        _sorted_pairs(value, "_c").alias("_pairs"), F.sum("_c").alias("group_events"),
        F.min(value).alias("_min"), F.max(value).alias("_max")).select(
        *group, *out, middle(_at_rank(F.col("_pairs"), lower), _at_rank(F.col("_pairs"), upper)))
    if large.isEmpty():
        return medians
    ranks = large.select(*group, F.explode(F.array(
        F.struct(F.lit("low").alias("which"), lower.alias("rank")),
        F.struct(F.lit("high").alias("which"), upper.alias("rank")))).alias("_r")).select(*group, "_r.*")
    at = select_ranks(weights, broadcast_if_small(cut_lineage(ranks), _GROUP_BYTES), group, value, "_c",
                      most_values)
    pick = lambda name: F.max(F.when(F.col("which") == name, F.col("at")))
    found = at.groupBy(*group).agg(pick("low").alias("_m1"), pick("high").alias("_m2"))
    return medians.unionByName(large.join(found, group).select(
        *group, *out, middle(F.col("_m1"), F.col("_m2"))))


def size_outlier(df: DataFrame, keys: list[str], metric: str, min_group_events: int,
                 deviate_ratio: float, max_outliers: int = 3, source: str = "source_id",
                 line: str = "line_no", ts: str | None = "ts_utc",
                 rows_per_task: int = GROUP_ROWS_PER_TASK) -> DataFrame:
    """Rows far from the median of their key group, at most ``max_outliers`` per group."""
    group = [source, *keys]
    sized = (df.where(not_null(keys)).withColumn("value", metric_value(df, metric))
             .where(F.col("value").isNotNull())
             .select(*group, F.col(line).alias("line_no"), "value",
                     (F.col(ts) if ts else F.lit(None).cast("timestamp")).alias("ts")))
    high, low = F.col("median") * deviate_ratio, F.col("median") / deviate_ratio
    facts = (group_medians(sized, keys, "value", source)
             .where((F.col("group_events") >= min_group_events) & (F.col("median") > 0)
                    & ((F.col("_max") > high) | (F.col("_min") < low)))
             .drop("_min", "_max"))
    out = join_group_facts(sized, facts, group, "group_events", ["line_no"], rows_per_task)
    out = out.where((F.col("value") > high) | (F.col("value") < low))
    distance = F.abs(F.col("value") - F.col("median"))
    return top_k(out, group, [distance.desc(), F.asc("line_no")], max_outliers)
