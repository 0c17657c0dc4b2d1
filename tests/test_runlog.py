import math
import random

import pytest
from pyspark.sql import functions as F

from molframe.operators.runlog import (
    best_checkpoint,
    best_epoch,
    early_stop,
    global_step,
    improvement_trail,
    last_window_loss,
    latest,
    topk_checkpoints,
    windowed_loss,
)

LOG = "run string, epoch bigint, loss double"


def walk(losses, patience, min_delta=0.0, first=0):
    """The stopping rule, one epoch at a time: (stop epoch, best epoch, best loss)."""
    best, at = math.inf, 0
    for epoch, loss in enumerate(losses, first):
        if loss < best:
            best, at = loss, epoch
        elif loss - best > min_delta and epoch - at > patience:
            return epoch, at, best
    return None, at, None if best == math.inf else best


def result(df):
    return {r["run"]: (r["stop_epoch"], r["best_epoch"], r["best_loss"]) for r in df.collect()}


def test_stop_fixture(spark):
    log = spark.createDataFrame([("a", i, v) for i, v in enumerate([5.0, 4.0, 3.0, 3.1, 3.2, 3.3])], LOG)
    assert result(early_stop(log, 2)) == {"a": (5, 2, 3.0)}
    nan = spark.createDataFrame([("a", 0, 2.0), ("a", 1, math.nan), ("a", 2, 1.0)], LOG)
    assert result(early_stop(nan, 0)) == {"a": (None, 2, 1.0)}
    lost = spark.createDataFrame([("a", 0, math.nan), ("a", 1, math.inf)], LOG)
    assert result(early_stop(lost, 0)) == {"a": (None, 0, None)}


@pytest.mark.parametrize("slices", [1, 9])
def test_stop_equals_the_walk(spark, slices):
    rng = random.Random(9)
    runs = {}
    for i in range(40):
        level, losses = 5.0, []
        for _ in range(300 if i == 0 else rng.randint(1, 25)):
            level += rng.uniform(-1, 0.8 if i else 0.9)
            losses.append(rng.choice([math.nan, math.inf]) if rng.random() < 0.05 else round(level, 2))
        runs[f"r{i}"] = losses
    log = spark.createDataFrame([(r, e, v) for r, vs in runs.items() for e, v in enumerate(vs)], LOG).repartition(7)
    for patience, delta in [(0, 0.0), (2, 0.0), (3, 0.5)]:
        got = result(early_stop(log, patience, delta, slices=slices))
        assert got == {r: walk(v, patience, delta) for r, v in runs.items()}


def test_stop_goes_on_from_state(spark):
    losses = [5, 4, 3, 3.5, 3.6, 3.7, 1.0]
    log = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(losses)], LOG)
    for cut_at in range(1, len(losses)):
        first = early_stop(log.filter(F.col("epoch") < cut_at), 1)
        both = early_stop(log.filter(F.col("epoch") >= cut_at), 1, state=first)
        assert result(both) == {"a": walk(losses, 1)}


def test_loss_windows(spark):
    log = spark.createDataFrame([("a", i, float(i)) for i in range(1, 8)], "run string, step bigint, loss double")
    got = windowed_loss(log, 3).orderBy("window").collect()
    assert [(r["window"], r["avg_loss"], r["n_steps"]) for r in got] == [(1, 2.0, 3), (2, 5.0, 3), (3, 7.0, 1)]
    assert last_window_loss(log, 3).first()["last_loss"] == 7.0


@pytest.mark.parametrize("slices", [1, 6])
def test_trail_steps_and_checkpoints(spark, slices):
    losses = [5.0, 6.0, 4.0, 4.0, math.nan, 3.0, 3.5]
    log = spark.createDataFrame([("a", i, v) for i, v in enumerate(losses)] + [("b", 0, 1.0)], LOG)
    trail = improvement_trail(log, "loss", slices=slices).filter("run = 'a'").orderBy("epoch")
    assert [r["epoch"] for r in trail.collect()] == [0, 2, 5]
    up = improvement_trail(log, "loss", "max", slices=slices).filter("run = 'a'").orderBy("epoch")
    assert [r["epoch"] for r in up.collect()] == [0, 1]
    steps = global_step(log, "run", ["epoch"], slices=slices)
    assert {(r["run"], r["epoch"]): r["step"] for r in steps.collect()}[("a", 6)] == 7
    top = topk_checkpoints(log, 2, step="epoch").filter("run = 'a'").orderBy("rank").collect()
    assert [(r["epoch"], r["loss"]) for r in top] == [(5, 3.0), (6, 3.5)]
    assert best_checkpoint(log, step="epoch").filter("run = 'a'").first()["best_step"] == 5


def test_best_epoch_prefers_the_earliest_and_takes_its_test_score(spark):
    log = spark.createDataFrame(
        [("a", 0, 0.7, 0.1), ("a", 1, 0.9, 0.2), ("a", 2, 0.9, 0.3), ("a", 3, math.nan, 0.4)],
        "run string, epoch bigint, score double, test double",
    )
    row = best_epoch(log, "score", "max", test="test").first()
    assert (row["best_epoch"], row["best_score"], row["test_score"]) == (1, 0.9, 0.2)
    assert best_epoch(log, "score", "min").first()["best_epoch"] == 0


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "run string, at int, name string")
    assert {r["run"]: r["name"] for r in latest(df, "run", ["at"]).collect()} == {"a": "y", "b": "z"}


def test_topk_limits_before_the_shuffle(spark):
    log = spark.range(1000).select((F.col("id") % 3).alias("run"), F.col("id").alias("step"), (F.col("id") * 1.0).alias("loss"))
    plan = topk_checkpoints(log)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
