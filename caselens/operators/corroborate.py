"""What sibling sources saw around a hit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage, spread
from .retrieve import top_k

MAX_WINDOW_SECONDS = 86_400
LIMIT = 20
_HIT = ["_case", "_source", "_line"]


def _levels(window_seconds: int) -> list[int]:
    """Bin widths in microseconds: powers of ten up to the first one above the window."""
    widths = [1]
    while widths[-1] < window_seconds * 1_000_000:
        widths.append(widths[-1] * 10)
    return widths


def _bins(low, high, widths: list[int]):
    """Bins that cover [low, high] exactly at the left end, ascending in width.

    From ``low`` the cover climbs through the levels like a carry in decimal counting: at
    each level the bins up to the next boundary of the level above. The widest level runs
    on to ``high``; what it covers beyond is cut by the time condition of the join.
    """
    def listed(width, first, last):
        bins = F.when(first <= last, F.sequence(first, last)).otherwise(
            F.array().cast("array<bigint>"))
        return F.transform(bins, lambda b: F.struct(
            F.lit(width).cast("bigint").alias("w"), b.alias("b")))

    parts, start = [], low
    floor = lambda value, width: F.floor(value / F.lit(width))
    for width, wider in zip(widths, widths[1:]):
        boundary = floor(start + (wider - 1), wider) * wider
        parts.append(listed(width, floor(start, width),
                            F.least(floor(boundary - 1, width), floor(high, width))))
        start = boundary
    parts.append(listed(widths[-1], floor(start, widths[-1]), floor(high, widths[-1])))
    return F.concat(*parts)


def corroborate(hits: DataFrame, events: DataFrame, sources: DataFrame,
                window_seconds: int = 300, limit: int = LIMIT, path: str = "norm.path",
                address: str = "norm.src_ip") -> tuple[DataFrame, DataFrame]:
    """(status per hit, the first corroborating events per hit).

    ``hits``: case_id, source_id, line_no. An event corroborates a hit when its source is
    another one of the same case and system, its time lies within the window (inclusive)
    and its path or its address is the same.

    Events of one key and time bin can be very many, so pairs are never listed. For bins of
    every power-of-ten width the first ``limit`` events of each source are kept; a hit's
    window is a short list of such bins, and the first ``limit`` events of the window are
    among the kept ones. The answer is exact.
    """
    if not isinstance(window_seconds, int) or not 1 <= window_seconds <= MAX_WINDOW_SECONDS:
        raise ValueError(f"window_seconds must be an integer in 1..{MAX_WINDOW_SECONDS}")
    half = window_seconds * 1_000_000
    widths = _levels(window_seconds)
    # An empty system is none.
    named = sources.select("source_id", "case_id", F.when(
        F.trim("system") != "", F.col("system")).alias("system"))
    flat = events.select(
        "source_id", "line_no", F.unix_micros("ts_utc").alias("_t"),
        F.col(path).cast("string").alias("_path"), F.col(address).cast("string").alias("_addr"))
    placed = flat.join(named, "source_id")

    asked_lines = cut_lineage(hits.select("case_id", "source_id", "line_no").distinct())
    hit_lines = flat.join(
        broadcast_if_small(asked_lines.select("source_id", "line_no").distinct(), 200),
        ["source_id", "line_no"]).withColumn("_line_there", F.lit(True))
    anchors = (asked_lines.join(hit_lines, ["source_id", "line_no"], "left")
               .join(named.select("source_id", "system"), "source_id", "left"))
    system_size = named.where(F.col("system").isNotNull()).groupBy("case_id", "system").agg(
        F.count(F.lit(1)).alias("_members"))
    anchors = cut_lineage(anchors.join(system_size, ["case_id", "system"], "left"))

    def keyed(df):
        """One row per comparison basis a row has."""
        return df.select("*", F.explode(F.array(
            F.struct(F.lit("path").alias("basis"), F.col("_path").alias("key")),
            F.struct(F.lit("addr").alias("basis"), F.col("_addr").alias("key")))).alias("_k")) \
            .select("*", "_k.basis", "_k.key").drop("_k").where(F.col("key").isNotNull())

    wanted = keyed(anchors.where(
        F.col("_t").isNotNull() & (F.col("_members") > 1))).select(
        "case_id", "system", "basis", "key", F.col("source_id").alias("_source"),
        F.col("line_no").alias("_line"), (F.col("_t") - half).alias("_lo"),
        (F.col("_t") + half).alias("_hi"))
    probes = wanted.select("*", F.explode(_bins(F.col("_lo"), F.col("_hi"), widths)).alias("_b")) \
        .select("*", F.col("_b.w").alias("_w"), F.col("_b.b").alias("_bin")).drop("_b")

    group = ["case_id", "system", "basis", "key"]
    coarse = widths[-1]
    near = wanted.select(*group, F.explode(F.sequence(
        F.floor(F.col("_lo") / F.lit(coarse)), F.floor(F.col("_hi") / F.lit(coarse))))
        .alias("_coarse")).distinct()
    # Only events whose key and coarse time some hit asks for are spread over the levels.
    asked = (keyed(placed.where(F.col("_t").isNotNull() & F.col("system").isNotNull()))
             .withColumn("_coarse", F.floor(F.col("_t") / F.lit(coarse)))
             .join(broadcast_if_small(near, 400), [*group, "_coarse"], "left_semi"))
    # An event becomes one row of each width, which are sorted in the task that made them.
    asked = spread(asked, "source_id", "line_no")
    levelled = asked.select(
        *group, "source_id", "line_no", "_t",
        F.explode(F.array(*[F.lit(w).cast("bigint") for w in widths])).alias("_w")).withColumn(
        "_bin", F.floor(F.col("_t") / F.col("_w")))
    first_in_bin = top_k(levelled, [*group, "_w", "_bin", "source_id"],
                         [F.asc("_t"), F.asc("line_no")], limit, "_r").drop("_r")

    found = (first_in_bin.join(probes, [*group, "_w", "_bin"])
             .where((F.col("source_id") != F.col("_source")) & (F.col("_t") >= F.col("_lo"))
                    & (F.col("_t") <= F.col("_hi")))
             .select(F.col("case_id").alias("_case"), "_source", "_line", "source_id", "line_no",
                     "_t").distinct())
    items = top_k(found, _HIT, [F.asc("_t"), F.asc("source_id"), F.asc("line_no")], limit)
    items = items.select(
        F.col("_case").alias("case_id"), F.col("_source").alias("hit_source_id"),
        F.col("_line").alias("hit_line_no"), "rank", "source_id", "line_no",
        F.timestamp_micros("_t").alias("ts_utc"))

    counted = items.groupBy("case_id", F.col("hit_source_id").alias("source_id"),
                            F.col("hit_line_no").alias("line_no")).agg(
        F.count(F.lit(1)).alias("_found"))
    status = (anchors.join(counted, ["case_id", "source_id", "line_no"], "left").select(
        "case_id", "source_id", "line_no",
        F.when(F.col("_line_there").isNull(), "dangling").when(F.col("_t").isNull(), "no_ts")
        .when(F.coalesce("_members", F.lit(0)) <= 1, "no_siblings")
        .when(F.col("_found") > 0, "ok").otherwise("none").alias("status"),
        F.coalesce("_found", F.lit(0)).alias("items")))
    return status, items


def dangling_hits(hits: DataFrame, events: DataFrame) -> DataFrame:
    """Hits whose line is not among the events: their chain of evidence is broken."""
    asked = cut_lineage(hits.select("source_id", "line_no").distinct())
    found = events.select("source_id", "line_no").join(
        broadcast_if_small(asked, 200), ["source_id", "line_no"])
    return hits.join(found, ["source_id", "line_no"], "left_anti")
