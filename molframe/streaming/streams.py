"""Arriving chunks and arriving step logs.

Each job runs with ``availableNow``: it drains what has arrived, in as many
micro-batches as the source's file limit makes, and stops. Checkpoints, sinks
and state tables live where the caller says, in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molframe.functions.tokens import hashed_fp, tokenize
from molframe.operators.clean import clean_by_length, drop_empty_features
from molframe.operators.runlog import early_stop, topk_checkpoints
from molframe.plans.lineage import cut


def utc_instant(ts: str) -> F.Column:
    """A zone-less timestamp read as UTC; watermarks need the zoned type."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(ts)).cast("timestamp")


def read_files(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """Stream of Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _drain(writer) -> None:
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def stream_featurize(
    source: DataFrame, id: str, sequence: str, target: str, checkpoint: str,
    max_len: int = 200, kind: str = "smiles", size: int = 1024, radius: int = 2,
) -> None:
    """Clean, fingerprint and append arriving sequences: no state, no shuffle."""
    kept = clean_by_length(source, sequence, max_len)
    bits = hashed_fp(tokenize(F.col(sequence), kind), size, radius)
    featurized = drop_empty_features(kept.select(id, bits.alias("x")))
    _drain(featurized.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append"))


def windowed_loss_stream(
    log: DataFrame, width: str = "1 hour", delay: str = "10 minutes", run: str = "run", ts: str = "ts", loss: str = "loss"
) -> DataFrame:
    """Mean loss per run and time window; state older than the watermark is dropped in append mode."""
    return (
        log.withWatermark(ts, delay)
        .groupBy(F.window(ts, width).alias("window"), F.col(run))
        .agg(F.avg(loss).alias("avg_loss"), F.count(F.lit(1)).alias("n_steps"))
        .select(F.col("window.start").alias("window_start"), run, "avg_loss", "n_steps")
    )


def stream_windowed_loss(log: DataFrame, target: str, checkpoint: str, mode: str = "append", **windowing) -> None:
    """Write windowed losses: closed windows appended, or in complete mode all windows per batch."""
    found = windowed_loss_stream(log, **windowing)
    if mode == "append":
        writer = found.writeStream.format("parquet").option("path", target).outputMode("append")
    else:
        # The whole result replaces the last one, so a repeated batch changes nothing.
        writer = found.writeStream.outputMode("complete").foreachBatch(
            lambda batch, _: batch.write.mode("overwrite").parquet(target)
        )
    _drain(writer.option("checkpointLocation", checkpoint))


#: Buckets of runs in which state is kept; a batch rewrites those it touches.
BUCKETS = 64
MARKS = "batch bigint, bucket int, slot int"


def _folded(
    target: str,
    tables: Mapping[str, str],
    step: Callable[[dict[str, DataFrame], DataFrame], Mapping[str, DataFrame]],
    key: str = "run",
    buckets: int = BUCKETS,
) -> Callable[[DataFrame, int], None]:
    """Fold batches into state tables (name and schema) kept in buckets of ``key``.

    A batch reads the buckets of its own keys and writes them anew into the
    other of two slots each; all other buckets stay as they are. ``done`` then
    names the slots that hold, so a batch repeated after a failure reads what it
    read before and overwrites what it wrote. ``step`` takes the touched buckets
    of each table and the batch, and returns them advanced.
    """
    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # Several passes read the batch.
        batch = batch.persist()
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]
        current = _marks(spark, target, number) if number > 0 else {}
        mine = {b: current[b] for b in touched if b in current}
        states = {name: _held(spark, target, name, schema, mine) for name, schema in tables.items()}
        second = [b for b, (_, slot) in mine.items() if slot == 0]
        for name, advanced in step(states, batch).items():
            placed = advanced.withColumns({"bucket": bucket, "batch": F.lit(number).cast("bigint")})
            placed = placed.withColumn("slot", F.col("bucket").isin(second).cast("int") if second else F.lit(0))
            (
                placed.repartition("bucket").write.partitionBy("bucket", "slot").mode("overwrite")
                .option("partitionOverwriteMode", "dynamic").parquet(f"{target}/{name}")
            )
        batch.unpersist()
        marks = [(number, b, int(b in second)) for b in touched]
        spark.createDataFrame(marks, MARKS).write.mode("append").parquet(f"{target}/done")

    return fold


def _marks(spark: SparkSession, target: str, before: int | None = None) -> dict[int, tuple[int, int]]:
    """Batch and slot that hold for each bucket, after all batches or those before one: a row a bucket."""
    marks = spark.read.schema(MARKS).parquet(f"{target}/done")
    if before is not None:
        marks = marks.filter(F.col("batch") < before)
    last = marks.groupBy("bucket").agg(F.max(F.struct("batch", "slot")).alias("last"))
    return {r["bucket"]: tuple(r["last"]) for r in last.collect()}


def _held(spark: SparkSession, target: str, name: str, schema: str, marks: Mapping[int, tuple[int, int]]) -> DataFrame:
    """Rows of a table in these buckets. Rows an older batch left in a slot are not of the batch marked."""
    if not marks:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(f"{schema}, batch bigint, bucket int, slot int").parquet(f"{target}/{name}")
    here = [
        (F.col("bucket") == bucket) & (F.col("slot") == slot) & (F.col("batch") == batch)
        for bucket, (batch, slot) in marks.items()
    ]
    return found.filter(reduce(lambda a, b: a | b, here)).drop("batch", "bucket", "slot")


def read_state(spark: SparkSession, target: str, name: str = "state") -> DataFrame:
    """State table after the last finished batch."""
    schema = spark.read.parquet(f"{target}/{name}").drop("batch", "bucket", "slot").schema
    return _held(spark, target, name, _ddl(schema), _marks(spark, target))


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def stream_topk(
    log: DataFrame, target: str, checkpoint: str, k: int = 5, run: str = "run", step: str = "step",
    loss: str = "loss", buckets: int = BUCKETS,
) -> None:
    """Keep the ``k`` best checkpoints per run as records arrive, in any order.

    Records of equal loss and step count each, as in ``topk_checkpoints``. State
    holds at most ``k`` rows a run; buckets of runs without new records are not read.
    """
    kept = log.select(run, step, loss)

    def merge(states: dict[str, DataFrame], batch: DataFrame) -> dict[str, DataFrame]:
        return {"state": topk_checkpoints(states["state"].unionByName(batch), k, run, step, loss).drop("rank")}

    fold = _folded(target, {"state": _ddl(kept.schema)}, merge, run, buckets)
    _drain(kept.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint))


STOP_STATE = "run {run}, stop_epoch bigint, best_epoch bigint, best_loss double"
#: Newest epoch seen, last epoch folded into the state, records that came too late for it.
RUN_ORDER = "run {run}, newest bigint, folded bigint, late bigint"
PENDING = "run {run}, epoch bigint, loss double"


def stream_early_stop(
    log: DataFrame, target: str, checkpoint: str, patience: int = 5, min_delta: float = 0.0,
    run: str = "run", epoch: str = "epoch", loss: str = "loss", slack: int = 0, buckets: int = BUCKETS,
) -> None:
    """Early stopping as epochs arrive, up to ``slack`` epochs out of order.

    The state per run is its best point and, once set, its stop. A record waits
    in the table ``pending`` until its run has shown an epoch ``slack`` further
    on, and is then folded in with the others in order of epochs. A record whose
    epoch is not beyond the last one folded, or is null, is too late: it changes
    nothing and is counted for its run in the table ``order`` (``late_records``).
    ``read_stops`` gives the stops with what still waits.

    A batch is folded in by the sliced batch operator, so one run that fills the
    batch is spread over many tasks, which per-key stream state could not do.
    """
    kind = log.schema[run].dataType.simpleString()
    tables = {"state": STOP_STATE, "order": RUN_ORDER, "pending": PENDING}
    tables = {name: schema.format(run=kind) for name, schema in tables.items()}
    arriving = log.select(
        F.col(run).alias("run"), F.col(epoch).cast("bigint").alias("epoch"), F.col(loss).cast("double").alias("loss")
    )

    def advance(states: dict[str, DataFrame], batch: DataFrame) -> dict[str, DataFrame]:
        # One row a run; its side of the join is unique, so a run that fills the batch can be split.
        known = states["order"].select("run", "newest", "folded", "late")
        seen = batch.groupBy("run").agg(F.max("epoch").alias("newest"))
        seen = seen.withColumns({"folded": F.lit(None).cast("bigint"), "late": F.lit(0).cast("bigint")})
        runs = known.unionByName(seen).groupBy(F.col("run").alias("_run")).agg(
            F.max("newest").alias("_newest"), F.max("folded").alias("_folded"), F.sum("late").alias("_late")
        )
        waiting = states["pending"].unionByName(batch)
        placed = waiting.join(runs, F.col("run").eqNullSafe(F.col("_run")), "left")
        late = F.col("epoch").isNull() | F.coalesce(F.col("epoch") <= F.col("_folded"), F.lit(False))
        ready = F.col("epoch") <= F.col("_newest") - slack
        # Written once: the fold, the counts and what still waits are taken from it.
        placed = cut(
            placed.select("run", "epoch", "loss", F.when(late, "late").when(ready, "ready").otherwise("wait").alias("lane"))
        )
        now = placed.filter("lane = 'ready'").select("run", "epoch", "loss")
        counted = placed.groupBy("run").agg(
            F.max(F.when(F.col("lane") == "ready", F.col("epoch"))).alias("now_folded"),
            F.count_if(F.col("lane") == "late").alias("now_late"),
        )
        order = runs.join(counted, F.col("run").eqNullSafe(F.col("_run")), "left").select(
            F.col("_run").alias("run"),
            F.col("_newest").alias("newest"),
            F.greatest("_folded", "now_folded").alias("folded"),
            (F.col("_late") + F.coalesce("now_late", F.lit(0))).alias("late"),
        )
        return {
            "state": early_stop(now, patience, min_delta, state=states["state"]),
            "order": order,
            "pending": placed.filter("lane = 'wait'").select("run", "epoch", "loss"),
        }

    fold = _folded(target, tables, advance, "run", buckets)
    _drain(arriving.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint))


def read_stops(spark: SparkSession, target: str, patience: int = 5, min_delta: float = 0.0) -> DataFrame:
    """Stop of each run if no more records come: what waits is folded in."""
    return early_stop(read_state(spark, target, "pending"), patience, min_delta, state=read_state(spark, target))


def late_records(spark: SparkSession, target: str) -> DataFrame:
    """``run, late``: records of each run that came too late to count."""
    return read_state(spark, target, "order").select("run", "late")
