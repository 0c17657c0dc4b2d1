"""Streams drained inside the query; the sink comes back as a batch."""

from pyspark.sql import functions as F

from molframe.catalog.base import ORACLE, register, rounded, table, training_log
from molframe.functions.arrays import joined
from molframe.plans.lineage import cut, scratch_path
from molframe.streaming.streams import (
    read_files,
    read_state,
    read_stops,
    stream_early_stop,
    stream_featurize,
    stream_topk,
    stream_windowed_loss,
    utc_instant,
)


def _stream(spark, sf_dir, name):
    # As a pattern the path may be one file or a folder of files.
    return read_files(spark, f"{sf_dir}/{name}.parque[t]", table(spark, sf_dir, name).schema)


@register(
    "stream_featurize",
    ORACLE["feat_hashed_fp"].replace("FROM documents)", "FROM documents WHERE length(text) <= 1000)")
    + " WHERE bits IS NOT NULL",
)
def featurized(spark, sf_dir):
    target = scratch_path(spark, "featurized")
    docs = _stream(spark, sf_dir, "documents").select("doc_id", "text")
    stream_featurize(docs, "doc_id", "text", target, scratch_path(spark, "ckpt"), max_len=1000, kind="words")
    return spark.read.parquet(target).select(
        "doc_id", F.size("x").cast("bigint").alias("n_bits"), F.md5(joined(F.col("x"))).alias("bits_md5")
    )


@register(
    "stream_windowed_loss",
    """
    SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS window_start, user_id AS run,
           round(avg(value), 6) AS avg_loss, count(*) AS n_steps
    FROM events GROUP BY 1, 2
    """,
)
def windowed(spark, sf_dir):
    target = scratch_path(spark, "windows")
    log = _stream(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), utc_instant("ts").alias("ts"), F.col("value").alias("loss")
    )
    # Complete mode also shows the windows still open at the end of the data.
    stream_windowed_loss(log, target, scratch_path(spark, "ckpt"), mode="complete")
    return spark.read.parquet(target).select(
        F.unix_seconds("window_start").alias("window_start"), "run", rounded("avg_loss").alias("avg_loss"), "n_steps"
    )


def _numbered_log(spark, sf_dir):
    """Training log with steps, written as the files a trainer would append."""
    path = scratch_path(spark, "log")
    training_log(spark, sf_dir).select("run", "step", "loss").write.parquet(path)
    return read_files(spark, path, spark.read.parquet(path).schema)


@register("stream_topk", ORACLE["topk_checkpoints"].replace("SELECT * FROM", "SELECT run, step, loss FROM"))
def topk(spark, sf_dir):
    target = scratch_path(spark, "topk")
    stream_topk(_numbered_log(spark, sf_dir), target, scratch_path(spark, "ckpt"))
    return read_state(spark, target)


@register("stream_early_stop", ORACLE["early_stop"])
def early(spark, sf_dir):
    target = scratch_path(spark, "stops")
    stream_early_stop(_numbered_log(spark, sf_dir), target, scratch_path(spark, "ckpt"), epoch="step")
    return read_state(spark, target)


@register("stream_early_stop_out_of_order", ORACLE["early_stop"])
def shuffled(spark, sf_dir):
    """Records up to seven steps behind the newest, in three appends; what still waits at the end is folded in."""
    log = training_log(spark, sf_dir).select("run", "step", "loss")
    arrival = F.col("step") + F.pmod(F.xxhash64("run", "step"), F.lit(8))
    path, target = scratch_path(spark, "log"), scratch_path(spark, "stops")
    numbered = cut(log.withColumn("arrival", arrival))
    last = F.lit(numbered.agg(F.max("arrival")).first()[0])
    for third in range(3):
        part = F.least(F.expr("arrival * 3") / (last + 1), F.lit(2)).cast("int") == third
        numbered.filter(part).drop("arrival").repartition(4).write.mode("append").parquet(path)
    stream = read_files(spark, path, log.schema, files_per_batch=4)
    stream_early_stop(stream, target, scratch_path(spark, "ckpt"), epoch="step", slack=8)
    return read_stops(spark, target)
