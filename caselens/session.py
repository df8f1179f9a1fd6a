"""Session settings, durable scratch space and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A DataFrame joined with a broadcast hint must stay below this many bytes.
BROADCAST_LIMIT_BYTES = 256 * 1024 * 1024
# Rows of one task that parses, sorts or widens each of them.
ROWS_PER_TASK = 100_000

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed join below an aggregate on the same key is split even though that
    # costs the aggregate one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Source ids such as 007 are texts, also as names of partitions.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Declared encodings such as GBK are decoded on the JVM.
    "spark.sql.legacy.javaCharsets": "true",
    # Malformed bytes become U+FFFD instead of ending the job.
    "spark.sql.legacy.codingErrorAction": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "caselens", **conf: str) -> SparkSession:
    """Create a session; on a cluster leave ``master`` unset and use spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``.

    Local mode without the setting falls back to a temporary folder, because driver
    and executors are then one process. A cluster without it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = os.path.join(tempfile.mkdtemp(prefix="caselens-"), "checkpoints")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh, not yet existing path inside the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def escape_partition(value: str | None) -> str:
    """The folder name Spark gives to a partition value."""
    if value is None or value == "":
        return "__HIVE_DEFAULT_PARTITION__"
    special = set('"#%\'*/:=?\\\x7f{[]^') | {chr(i) for i in range(1, 32)}
    return "".join(f"%{ord(c):02X}" if c in special else c for c in value)


def path_exists(spark: SparkSession, folder: str) -> bool:
    """Whether a file system Spark can reach has this path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any file system Spark can reach, if it exists."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage and continue from there."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Mark an already materialised ``df`` for broadcast when its size allows it.

    ``df`` must be cheap to count (checkpointed or a written table). Beyond the limit
    it is returned unmarked and the join shuffles.
    """
    rows = df.count()
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_LIMIT_BYTES else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores for costly work per row, with a bounded number of rows in a task.

    A stored table has splits by its bytes; a small file can hold millions of rows, and splits
    without a row group of their own are empty. Rows are counted by split, which reads no
    column, and dealt anew when the splits are too few or too long; by the hash of ``keys``,
    else in turn.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits, most, rows = df.groupBy(F.spark_partition_id().alias("_split")).agg(
        F.count(F.lit(1)).alias("_n")).agg(
        F.count(F.lit(1)), F.coalesce(F.max("_n"), F.lit(0)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    if splits >= cores and most <= ROWS_PER_TASK:
        return df
    return df.repartition(max(cores, -(-rows // ROWS_PER_TASK)), *keys)
