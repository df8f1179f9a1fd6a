"""The corpus pipeline: toxicity, near duplicates, decontamination, mixing, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from caselens.llm.storage import free_name, stored
from caselens.session import configure, new_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.3; the network learns from the input itself."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = toxicity.train_network(docs, labels)
    score = free_name("_score", docs.columns)
    return toxicity.score_toxicity(docs, net, result=score).where(F.col(score) < 0.3).drop(score)


def _row_key(docs: DataFrame) -> Column:
    """Null flag, id and hash of a whole row: what tells rows with one id, or none, apart."""
    # Maps have no hash and no order of their own; as JSON text they have.
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    values = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind or "variant" in kind
              else F.col(f"`{c}`") for c, kind in kinds.items()]
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"),
                    F.xxhash64(*values).alias("hash"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group at a similarity of 0.8 over five-word shingles.

    The row with the smallest id stays; of rows that repeat an id, that with the smallest hash
    of all columns; rows without an id come last; of rows alike in all columns one stays.
    Texts without words have no group and stay, all of them.
    """
    key = free_name("_row", docs.columns)
    keyed = docs.withColumn(key, _row_key(docs))
    groups = ngram_join.ngram_groups(keyed, k=5, num=8, den=10, doc_id=key)
    # Rows alike in all columns share a key: they part from the others and one stays.
    changed = stored(groups.where("n_shingles > 0").groupBy(F.col("doc_id").alias(key)).agg(
        F.max(F.col("component_id") != F.col("doc_id")).alias("goes"),
        F.count(F.lit(1)).alias("n")).where("goes or n > 1"), "changed")
    single = keyed.join(changed.select(key), key, "left_anti")
    first = keyed.join(changed.where("not goes").select(key), key, "left_semi").dropDuplicates([key])
    return single.union(first).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = free_name("_items", docs.columns)
    return decontaminate.find_benchmark_items(docs, benchmark, result=items).where(
        F.size(items) == 0).drop(items)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once and those of small sources up to twice."""
    added = tuple(free_name(name, docs.columns) for name in ("_pass", "_place", "_weight"))
    return mixing.mix(docs, out=added).drop(*added)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and the slot in it of every row that reached the end."""
    return sharding.assign_shards(docs, keep=("doc_id", "source", "lang", "n_chars"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("temperature_mixing", mix_sources),
    ("hilbert_sharding", shard),
]

# Neither a recurrent network nor banded alignment is SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages; what each keeps is written to shared storage and read again."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
