"""Where intermediate data lives, and how lineage is cut.

The session names a folder that every executor can reach: ``spark.checkpoint.dir``,
or ``SparkContext.setCheckpointDir`` where that setting is not given. Nothing is
ever kept in a folder of one machine.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach."""
    context = spark.sparkContext
    named = context.getConf().get(CHECKPOINT_SETTING) or context.getCheckpointDir()
    if not named:
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder shared by all executors")
    return named.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from there.

    A table survives lost executors, is pruned by column, and its footers give
    later stages its true size, which a checkpointed RDD would not.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one partition of a shuffle that is sized by its rows.
PARTITION_ROWS = 1 << 20


def partitions(df: DataFrame, rows: int, most: int = PARTITION_ROWS) -> int:
    """Partitions of a shuffle of so many rows: as set, or more, so that what a task holds does not grow with the input."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // most))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Even out a plain scan that has fewer splits than the cluster has cores.

    For heavy per-row work only. A large input has splits enough and is left
    alone, so the shuffle this adds is never larger than a few splits.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
