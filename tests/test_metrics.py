import math
import random

import pytest
from pyspark.sql import functions as F

from molframe.operators import metrics as M
from molframe.operators.transform import fit, fit_chain


def pairwise(rows):
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    if not pos or not neg:
        return None
    return sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("slices", [1, 25])
def test_auc_equals_pairwise_counting(spark, slices):
    rng = random.Random(2)
    rows = [("hot", rng.randint(0, 1), rng.choice([0.5, round(rng.random(), 3)])) for _ in range(200)]
    rows += [("b", rng.randint(0, 1), rng.random()) for _ in range(50)] + [("one", 1, 0.3), ("one", None, 0.2)]
    df = spark.createDataFrame(rows, "task string, y int, p double")
    got = {r["task"]: r["roc_auc"] for r in M.roc_auc(df, "y", "p", ["task"], slices).collect()}
    for task in ("hot", "b"):
        assert got[task] == pytest.approx(pairwise([(y, p) for t, y, p in rows if t == task]))
    assert got["one"] is None
    mean = M.task_mean(M.roc_auc(df, "y", "p", ["task"]), "roc_auc").first()
    assert mean["n_tasks"] == 2 and mean["roc_auc"] == pytest.approx((got["hot"] + got["b"]) / 2)


def test_auc_fixture(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, p double")
    assert M.roc_auc(df, "y", "p").first()["roc_auc"] == 0.875


def test_errors(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (3.0, 1.0, 3.0), (None, 1.0, 9.0)], "y double, p double, w double")
    assert M.rmse(df, "y", "p").first()[0] == pytest.approx(math.sqrt(2.5))
    assert M.rmse(df, "y", "p", "w").first()[0] == pytest.approx(math.sqrt(13 / 4))
    assert M.mae(df, "y", "p").first()[0] == 1.5 and M.mse(df, "y", "p").first()[0] == 2.5
    both = df.withColumns({"m": F.lit(10.0), "s": F.lit(2.0)})
    assert M.rmse_denormalized(both, "y", "p", "m", "s").first()[0] == pytest.approx(2 * math.sqrt(2.5))


def test_cross_entropy_survives_large_logits(spark):
    df = spark.createDataFrame([([1000.0, 0.0], 0), ([0.0, 0.0], 1)], "z array<double>, y int")
    assert M.cross_entropy(df, "z", "y").first()[0] == pytest.approx(math.log(2) / 2)


def test_steps_and_runs(spark):
    assert M.total_steps(spark.range(1000), 32, 3, 2).first()["total_steps"] == 20
    runs = spark.createDataFrame([("a", 0.7), ("a", 0.8), ("a", 0.9)], "name string, score double")
    row = M.run_summary(runs, ["name"]).first()
    assert (round(row["mean"], 6), round(row["std"], 6), round(row["spread"], 6)) == (0.8, 0.08165, 0.2)


LONG = "id int, task string, y double, w double"


def values(df):
    return [r["y"] for r in df.orderBy("id").collect()]


def test_transformers(spark):
    const = spark.createDataFrame([(i, "t", 4.0, 1.0) for i in range(3)], LONG)
    assert values(fit("Normalization", const).apply(const)) == [0.0] * 3
    assert values(fit("minmax", const).apply(const)) == [0.0] * 3
    logged = spark.createDataFrame([(0, "t", 0.0, 1.0), (1, "t", math.e - 1, 1.0)], LONG)
    assert values(fit("log", logged).apply(logged)) == pytest.approx([0.0, 1.0])
    gap = spark.createDataFrame([(0, "t", 1.0, 1.0), (1, "t", 0.0, 1.0), (2, "t", None, 0.0), (3, "t", 0.0, 1.0)], LONG)
    assert [r["w"] for r in fit("balancing", gap).apply(gap).orderBy("id").collect()] == [3.0, 1.5, 0.0, 1.5]
    wild = spark.createDataFrame([(0, "t", -9.0, 1.0), (1, "t", None, 0.0), (2, "t", 9.0, 1.0)], LONG)
    clip = fit("clipping", wild, limit=2.0)
    assert values(clip.apply(wild)) == [-2.0, None, 2.0]
    with pytest.raises(ValueError):
        clip.invert(wild)


def test_chain_is_fitted_on_raw_rows_and_inverts(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(i, f"t{i % 3}", rng.uniform(0, 50), 1.0) for i in range(90)], LONG)
    train = rows.filter("id < 60")
    chain = fit_chain(["normalization", "MinMax"], train)
    there = chain.apply(rows)
    back = chain.invert(there)
    assert values(back) == pytest.approx(values(rows))
    low = train.groupBy("task").agg(F.min("y").alias("low"), F.max("y").alias("high"), F.avg("y").alias("m"), F.stddev_pop("y").alias("s"))
    want = rows.join(low, "task").withColumn("y", (((F.col("y") - F.col("m")) / F.col("s")) - F.col("low")) / (F.col("high") - F.col("low")))
    assert values(there) == pytest.approx(values(want))


def test_user_transformer_in_a_chain(spark):
    from molframe.operators.transform import Fitted

    rows = spark.createDataFrame([(0, "t", 3.0, 1.0)], LONG)
    double = lambda train: Fitted("double", None, (), {"y": F.col("y") * 2}, {"y": F.col("y") / 2})
    chain = fit_chain([double, "log"], rows)
    assert values(chain.invert(chain.apply(rows))) == pytest.approx([3.0])


def test_user_metric_with_task_average(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 5.0), ("b", 1.0, 1.0)], "task string, y double, p double")
    worst = lambda y, p: F.max(F.abs(y - p))
    assert M.user_metric(df, "worst", worst, "y", "p").first()["worst"] == 4.0
    assert M.user_metric(df, "worst", worst, "y", "p", average_over="task").first()["worst"] == 2.0
