"""Training logs ``(run, step, loss, ...)``: windows of loss, early stopping, checkpoints.

One run may hold most of the log, so nothing here gathers a run in one task:
plain aggregates combine on the map side, running values are sliced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molframe.plans.ordered import Running, running, slice_by_range

INFINITY = float("inf")


def global_step(
    log: DataFrame, run: str, order: Sequence[str], name: str = "step", slices: int | None = None
) -> DataFrame:
    """Number the records of each run from 1, across epochs."""
    return running(slice_by_range(log, order, [run], slices), **{name: Running("count")})


def windowed_loss(log: DataFrame, k: int, run: str = "run", step: str = "step", loss: str = "loss") -> DataFrame:
    """Mean loss per window of ``k`` steps; the last window may be short."""
    window = F.ceil(F.col(step) / F.lit(k)).cast("bigint").alias("window")
    return log.groupBy(run, window).agg(F.avg(loss).alias("avg_loss"), F.count(F.lit(1)).alias("n_steps"))


def last_window_loss(log: DataFrame, k: int, run: str = "run", step: str = "step", loss: str = "loss") -> DataFrame:
    """Mean loss of the last window of each run: what a fit returns."""
    return windowed_loss(log, k, run, step, loss).groupBy(run).agg(
        F.max("window").alias("window"), F.max_by("avg_loss", "window").alias("last_loss")
    )


def _improvable(loss: Column) -> Column:
    """NaN and infinity never improve on anything."""
    return loss < F.lit(INFINITY)


def early_stop(
    log: DataFrame,
    patience: int = 5,
    min_delta: float = 0.0,
    run: str = "run",
    epoch: str = "epoch",
    loss: str = "loss",
    state: DataFrame | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Where each run stops, with the best epoch and loss known by then.

    A strictly lower loss resets; otherwise the run stops at the first epoch
    with ``loss - best > min_delta`` and ``epoch - best_epoch > patience``.
    The best so far is a running minimum of (loss, epoch), so one sliced pass
    finds the stop. ``state`` holds an earlier result to go on from.
    """
    rows = log.select(
        F.col(run).alias("run"),
        F.lit(1).alias("part"),
        F.col(epoch).cast("bigint").alias("epoch"),
        F.col(loss).cast("double").alias("loss"),
        F.lit(None).cast("bigint").alias("stopped"),
    )
    rows = rows.withColumn("point", F.when(_improvable(F.col("loss")), F.struct("loss", "epoch")))
    if state is not None:
        # Earlier results go in front of their run as one more row: no join on a skewed run.
        best = F.struct(F.col("best_loss").alias("loss"), F.col("best_epoch").alias("epoch"))
        earlier = state.select(
            "run",
            F.lit(0).alias("part"),
            F.lit(0).cast("bigint").alias("epoch"),
            F.lit(None).cast("double").alias("loss"),
            F.col("stop_epoch").alias("stopped"),
            F.when(F.col("best_loss").isNotNull(), best).alias("point"),
        )
        rows = rows.unionByName(earlier)
    seen = running(
        slice_by_range(rows, ["part", "epoch"], ["run"], slices),
        so_far=Running("min", F.col("point")),
        **({"ended": Running("max", F.col("stopped"))} if state is not None else {}),
    )
    if state is None:
        seen = seen.withColumn("ended", F.col("stopped"))

    best_loss = F.coalesce(F.col("so_far.loss"), F.lit(INFINITY))
    best_epoch = F.coalesce(F.col("so_far.epoch"), F.lit(0))
    gap = F.col("loss") - best_loss
    stops = (
        ~F.isnan("loss")
        & ~F.isnan(gap)
        & (gap > min_delta)
        & (F.col("epoch") - best_epoch > patience)
        & F.col("ended").isNull()
    )
    last = seen.groupBy("run").agg(
        F.min(F.when(stops, F.struct("epoch", "so_far"))).alias("stop"),
        F.min("so_far").alias("overall"),
        F.max("stopped").alias("stopped"),
        F.min(F.when(F.col("part") == 0, F.col("point"))).alias("earlier"),
    )
    # A run that stopped before keeps the best it had then.
    best = (
        F.when(F.col("stopped").isNotNull(), F.col("earlier"))
        .when(F.col("stop").isNotNull(), F.col("stop.so_far"))
        .otherwise(F.col("overall"))
    )
    return last.select(
        "run",
        F.coalesce("stopped", F.col("stop.epoch")).alias("stop_epoch"),
        F.coalesce(best["epoch"], F.lit(0).cast("bigint")).alias("best_epoch"),
        best["loss"].alias("best_loss"),
    )


def best_epoch(
    log: DataFrame, metric: str, mode: str = "min", run: str = "run", epoch: str = "epoch", test: str | None = None
) -> DataFrame:
    """Earliest epoch with the best validation score, and the test score taken there."""
    usable = log.filter(F.col(metric).isNotNull() & ~F.isnan(F.col(metric).cast("double")))
    sign = 1 if mode == "min" else -1
    record = F.struct(
        (F.col(metric) * sign).alias("rank"), F.col(epoch).alias("epoch"), F.col(metric).alias("score"),
        (F.col(test) if test else F.lit(None).cast("double")).alias("test"),
    )
    top = usable.groupBy(run).agg(F.min(record).alias("top"))
    columns = [F.col("top.epoch").alias("best_epoch"), F.col("top.score").alias("best_score")]
    return top.select(run, *columns, *([F.col("top.test").alias("test_score")] if test else []))


def improvement_trail(
    log: DataFrame,
    metric: str,
    mode: str = "min",
    run: str = "run",
    epoch: str = "epoch",
    slices: int | None = None,
) -> DataFrame:
    """The epochs at which a strictly better score was reached."""
    usable = log.filter(F.col(metric).isNotNull() & ~F.isnan(F.col(metric).cast("double")))
    sliced = slice_by_range(usable, [epoch], [run], slices)
    seen = running(sliced, _before=Running(mode, F.col(metric), inclusive=False))
    better = F.col(metric) < F.col("_before") if mode == "min" else F.col(metric) > F.col("_before")
    return seen.filter(F.col("_before").isNull() | better).drop("_before")


def topk_checkpoints(
    log: DataFrame, k: int = 5, run: str = "run", step: str = "step", loss: str = "loss"
) -> DataFrame:
    """The ``k`` checkpoints of each run with the lowest loss.

    The rank filter is pushed below the shuffle as a per-task limit per run, so
    a run of any length sends at most ``k`` rows per task.
    """
    order = Window.partitionBy(run).orderBy(F.col(loss).asc(), F.col(step).asc())
    usable = log.filter(F.col(loss).isNotNull() & ~F.isnan(loss))
    return usable.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def best_checkpoint(log: DataFrame, run: str = "run", step: str = "step", loss: str = "loss") -> DataFrame:
    """Step with the lowest loss of each run, the earliest among equals."""
    usable = log.filter(F.col(loss).isNotNull() & ~F.isnan(loss))
    lowest = F.min(F.struct(F.col(loss).alias("loss"), F.col(step).alias("step"))).alias("best")
    return usable.groupBy(run).agg(lowest).select(
        run, F.col("best.step").alias("best_step"), F.col("best.loss").alias("best_loss")
    )


def latest(df: DataFrame, by: str, order: Sequence[str]) -> DataFrame:
    """The last record of each group."""
    rest = [c for c in df.columns if c != by]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("last")
    return df.groupBy(by).agg(last).select(by, "last.*")
