"""Mixing sources to target weights by temperature, realised as block permutations.

Source weights are token shares raised to an exponent and normalised. The exponent is
bisected until the mixture meets a repetition limit or a target entropy. Every source then
gets its token budget: whole passes over all its rows, and one partial pass over blocks of
a random permutation. The budget of the mixture is such that the source with the smallest
ratio is passed once, so no row is dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = 1024


def weights_at(tokens: list[int], exponent: float) -> list[float]:
    total = sum(tokens)
    raised = [(t / total) ** exponent for t in tokens]
    return [r / sum(raised) for r in raised]


def passes_at(tokens: list[int], exponent: float) -> list[float]:
    """How often each source is read when the least read source is read once."""
    ratio = [w / t for w, t in zip(weights_at(tokens, exponent), tokens, strict=True)]
    return [r / min(ratio) for r in ratio]


def find_exponent(tokens: list[int], repetition: float | None, entropy: float | None) -> float:
    """The least exponent in 0..1 within the repetition limit, or the largest that reaches
    the share ``entropy`` of the greatest possible entropy."""
    def fits(a: float) -> bool:
        if repetition is not None:
            return max(passes_at(tokens, a)) <= repetition
        h = -sum(w * math.log(w) for w in weights_at(tokens, a) if w)
        return h < entropy * math.log(len(tokens))
    if len(tokens) < 2 or fits(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high if repetition is not None else low


def source_plan(docs: DataFrame, source: str = "source", repetition: float | None = 2.0,
                entropy: float | None = None) -> list[dict]:
    """Tokens, weight and passes of every source; one row per source reaches the driver.

    The number of sources is a property of the mixture, not of the corpus. Words between
    white space, plus one per row, count as tokens; so null and empty texts count one. A
    null source is a source of its own.
    """
    tokens = _tokens()
    rows = docs.groupBy(F.col(source).alias("s")).agg(F.sum(tokens).alias("t")).collect()
    rows = sorted(rows, key=lambda r: (r["s"] is not None, str(r["s"])))
    if not rows:
        return []
    counts = [r["t"] for r in rows]
    exponent = find_exponent(counts, repetition, entropy)
    return [{"source": r["s"], "tokens": t, "weight": w, "passes": p, "exponent": exponent}
            for r, t, w, p in zip(rows, counts, weights_at(counts, exponent),
                                  passes_at(counts, exponent), strict=True)]


def _tokens():
    text = F.trim(F.coalesce("text", F.lit("")))
    return F.length(text) - F.length(F.translate(text, " \n\t", "")) + 1


def _share(block, order):
    """Where a hash stands in the block permutation, from 0 to 1."""
    return (block + order / F.lit(2.0 ** 64) + F.lit(0.5)) / F.lit(BLOCKS)


def mix(docs: DataFrame, source: str = "source", doc_id: str = "doc_id",
        repetition: float | None = 2.0, entropy: float | None = None, seed: int = 17,
        out: tuple[str, str, str] = ("_pass", "_place", "_weight")) -> DataFrame:
    """All columns of ``docs`` plus pass (from 0), place and weight of its source, each row as
    often as its source is read.

    Every pass has its own seeded permutation of the blocks and of the rows in them. The
    partial pass takes blocks in its order while their tokens fit into the budget, and rows of
    the next block while they still fit. ``place`` (0 to 1) is a row's place in the mixture:
    the passes of each source follow each other from 0 to 1, so that read in order of place
    every stretch of the mixture holds the sources at their weights, without a sort here.
    Equal rows are taken independently of each other only when their ids differ. Tables
    without rows stay empty; columns of ``docs`` named like the results are replaced by them.
    """
    plan = source_plan(docs, source, repetition, entropy)
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame(
        [(r["source"], int(r["passes"] + 1e-9),
          int((r["passes"] + 1e-9) % 1 * r["tokens"]), r["passes"], r["weight"]) for r in plan],
        docs.select(F.col(source).alias("_s")).schema.simpleString()[7:-1].replace(":", " ", 1)
        + ", _whole int, _budget long, _passes double, _weight double"))
    order = F.xxhash64(F.col(doc_id).cast("string"), F.coalesce("text", F.lit("")), F.lit(seed))
    # The user's columns travel inside one, so that no name of theirs meets one of these.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       F.col(source).alias("_source"), order.alias("_order"),
                       F.pmod(order, F.lit(BLOCKS)).alias("_block"),
                       _tokens().cast("long").alias("_n"))
    rows = rows.join(table, F.col("_source").eqNullSafe(F.col("_s")))
    # Block totals: combinable, at most BLOCKS rows a source.
    totals = rows.groupBy("_s", "_block", "_budget").agg(F.sum("_n").alias("_t"))
    totals = totals.withColumn("_end", F.sum("_t").over(
        Window.partitionBy("_s").orderBy("_block")))
    edge = totals.where((F.col("_end") > F.col("_budget"))
                        & (F.col("_end") - F.col("_t") <= F.col("_budget"))).select(
        F.col("_s").alias("_es"), F.col("_block").alias("_edge"),
        (F.col("_budget") - F.col("_end") + F.col("_t")).alias("_room"))
    rows = rows.join(F.broadcast(edge), F.col("_s").eqNullSafe(F.col("_es")), "left")
    # One block a source is cut inside: by tokens of rows earlier in the permutation.
    inside = rows.where("_block = _edge").groupBy("_s", "_order").agg(F.sum("_n").alias("_t"))
    inside = inside.withColumn("_upto", F.sum("_t").over(
        Window.partitionBy("_s").orderBy("_order")))
    last = inside.join(F.broadcast(edge), F.col("_s").eqNullSafe(F.col("_es"))).where(
        "_upto <= _room").groupBy(F.col("_s").alias("_ls")).agg(F.max("_order").alias("_last"))
    rows = rows.join(F.broadcast(last), F.col("_s").eqNullSafe(F.col("_ls")), "left")
    more = F.coalesce((F.col("_block") < F.col("_edge"))
                      | ((F.col("_block") == F.col("_edge")) & (F.col("_order") <= F.col("_last"))),
                      F.lit(False))
    passes = F.col("_whole") + more.cast("int")
    taken = rows.select("*", F.explode(F.sequence(F.lit(0), passes - 1)).alias("_pass"))
    again = F.xxhash64("_order", "_pass")
    # What the partial pass takes of the permutation is stretched to its part of the passes.
    cut = F.coalesce(_share(F.col("_edge"), F.col("_last")), F.col("_edge") / F.lit(BLOCKS))
    share = F.when(F.col("_pass") < F.col("_whole"), _share(F.pmod(again, F.lit(BLOCKS)), again)).otherwise(
        F.try_divide(_share(F.col("_block"), F.col("_order")), cut)
        * (F.col("_passes") - F.col("_whole")))
    return taken.select(
        *[F.col(f"_row.`{c}`") for c in docs.columns if c not in out],
        F.col("_pass").alias(out[0]), ((F.col("_pass") + share) / F.col("_passes")).alias(out[1]),
        F.col("_weight").alias(out[2]))
