"""Registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    content_sort, decontaminate, hard_negatives, kmeans_tree, licenses, main_text, mixing,
    ngram_join, periodic_runs, personal_data, repeated_spans, sharding, toxicity,
)
from .oracles import ORACLES  # noqa: F401


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontaminate(spark, folder):
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.find_benchmark_items(docs, _table(spark, folder, "benchmark"))
    return found.select("doc_id", (F.size("_items") > 0).alias("contaminated"),
                        F.col("_items.item_id").alias("item_ids"),
                        F.col("_items.edits").alias("edits"))


def op2_temperature_mix(spark, folder):
    docs = _table(spark, folder, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select(
        "doc_id", "source", F.col("_pass").alias("pass"), F.col("_place").alias("place"),
        F.col("_weight").alias("weight"))


def op3_kmeans_tree(spark, folder):
    return kmeans_tree.neighbours(_table(spark, folder, "embeddings"))


def op4_hilbert_shards(spark, folder):
    return sharding.assign_shards(_table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op5_license_rules(spark, folder):
    return licenses.scan_licenses(_table(spark, folder, "documents"))


def op6_personal_data(spark, folder):
    docs = _table(spark, folder, "documents")
    return personal_data.find_personal_data(docs, personal_data.fit(docs))


def op7_suffix_array_dedup(spark, folder):
    return repeated_spans.remove_repeats(_table(spark, folder, "documents"))


def op8_ngram_jaccard_join(spark, folder):
    groups = ngram_join.ngram_groups(_table(spark, folder, "documents"), k=3, num=90, den=100)
    return groups.select("doc_id", "n_shingles", "component_id")


def op9_main_text(spark, folder):
    return main_text.extract_main_text(_table(spark, folder, "pages"))


def op10_toxicity(spark, folder):
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    net = toxicity.train_network(docs, _table(spark, folder, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return toxicity.score_toxicity(docs, net).select(
        "doc_id", held_out.alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= 0.3).cast("int").alias("predicted"))


def with_repeated_parts(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in one text of ten, by the id's checksum, the words from one place on
    become repetitions of the words that follow it. Null ids and wordless texts stay."""
    chosen = F.crc32(F.col("doc_id").cast("string"))
    split = F.when(chosen % 10 == 0, F.filter(
        F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = docs.select("doc_id", "text", F.floor(chosen / 10).alias("g"), split.alias("words"))
    rows = rows.withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    part = F.slice("words", F.col("a") + 1, F.col("p"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    repeated = F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")),
                                F.flatten(F.array_repeat(part, times))), F.lit(1), F.col("n"))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(
        F.col("text")).alias("text"))


def op11_periodic_runs(spark, folder):
    docs = with_repeated_parts(_table(spark, folder, "documents"))
    found = periodic_runs.find_runs(docs)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    found = found.select("doc_id", "collapsed", F.size("runs").cast("long").alias("n_runs"),
                         best.alias("best"), lines.alias("lines"))
    return found.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(-1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("lines", lambda line: F.concat(line, F.lit("\n"))), ""), 256)
        .alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_content_sort(spark, folder):
    return content_sort.find_exact_copies(_table(spark, folder, "documents"))


def op13_hard_negatives(spark, folder):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(_table(spark, folder, "embeddings"), label=label)


QUERIES = {f.__name__: f for f in (
    op1_decontaminate, op2_temperature_mix, op3_kmeans_tree, op4_hilbert_shards,
    op5_license_rules, op6_personal_data, op7_suffix_array_dedup, op8_ngram_jaccard_join,
    op9_main_text, op10_toxicity, op11_periodic_runs, op12_content_sort, op13_hard_negatives)}
