import random

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from molframe.operators.forest import STUMP, bit_features, dense_features, evaluate, fit_forest, fit_tasks, load, predict, run_repeated, save
from molframe.operators.metrics import accuracy
from molframe.operators.transform import fit_balancing, fit_chain

SMALL = {"trees": 8, "depth": 4}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for i in range(300):
        x = [rng.random() for _ in range(4)]
        data.append((i, "train" if i < 200 else "valid" if i < 250 else "test", x, float(x[0] > 0.5), 3 * x[1] + 100))
    return dense_features(spark.createDataFrame(data, "id int, split string, x array<double>, y double, z double"), "x")


def test_classifier_learns_and_reloads(spark, rows, tmp_path):
    model = fit_forest(rows.filter("split = 'train'"), "classification", seed=1, **SMALL)
    preds = predict(model, rows, ["id", "split", "y"])
    scores = {r["split"]: r["accuracy"] for r in accuracy(preds, "y", "y_pred", ["split"]).collect()}
    assert scores["test"] > 0.9
    assert {r["score"] > 0.9 for r in evaluate(model, rows, "classification").collect()} == {True}
    save(model, str(tmp_path / "m"))
    again = predict(load(str(tmp_path / "m"), "classification"), rows, ["id", "split", "y"])
    assert sorted(map(tuple, preds.collect())) == sorted(map(tuple, again.collect()))


def test_repeated_regression_scores_in_label_units(rows):
    long = rows.select("id", "split", "_features", F.lit("z").alias("task"), F.col("z").alias("y"), F.lit(1.0).alias("w"))
    chain = fit_chain(["normalization"], long.filter("split = 'train'"))
    scores, summary = run_repeated(long, "regression", chain=chain, **SMALL)
    assert scores.count() == 6 and {r["split"] for r in summary.collect()} == {"valid", "test"}
    plain, _ = run_repeated(long, "regression", seeds=(0,), **SMALL)
    a = {r["split"]: r["score"] for r in scores.filter("run = 0").collect()}
    b = {r["split"]: r["score"] for r in plain.collect()}
    assert all(abs(a[s] - b[s]) < 0.2 for s in a) and max(a.values()) < 0.6


def test_any_estimator_may_be_built(rows):
    labelled = rows.select("id", "split", "_features", F.lit("t").alias("task"), "y", F.lit(1.0).alias("w"))
    build = lambda seed: LogisticRegression(featuresCol="_features", labelCol="y", predictionCol="y_pred", probabilityCol="_probability")
    scores, _ = run_repeated(labelled, "classification", seeds=(0,), build=build)
    assert min(r["score"] for r in scores.collect()) > 0.9


def test_tasks_use_their_own_labelled_rows(rows):
    gaps = rows.withColumn("t1", F.when(F.col("id") % 3 != 0, F.col("y"))).withColumn("t2", 1 - F.col("y"))
    out = fit_tasks(gaps, ["t1", "t2"], "id", **SMALL)
    assert out.count() == 600
    assert accuracy(out.filter("split = 'test'"), "y", "y_pred", ["task"]).filter("accuracy > 0.85").count() == 2


def test_bits_become_sparse_vectors(spark):
    df = bit_features(spark.createDataFrame([([1, 5],), ([],)], "bits array<int>"), "bits", 8)
    vectors = [r["_features"] for r in df.collect()]
    assert list(vectors[0].indices) == [1, 5] and vectors[0].size == 8 and vectors[1].numNonzeros() == 0


def test_weights_decide_and_stumps_take_the_best_split(spark):
    data = [(i, "train", [float(i % 2), float(i < 30)], float(i < 30 and i % 10 != 0)) for i in range(100)]
    rows = dense_features(spark.createDataFrame(data, "id int, split string, x array<double>, t double"), "x")
    plain = fit_tasks(rows, ["t"], "id", **STUMP)
    assert plain.filter("y_pred = 1").count() == 30
    # Class 1 is rare; weighed alike, both classes have half of all weight.
    rare = rows.withColumn("t", F.when(F.col("id") < 30, (F.col("id") < 9).cast("double")).otherwise(0.0))
    assert fit_tasks(rare, ["t"], "id", **STUMP).filter("y_pred = 1").count() == 0
    assert fit_tasks(rare, ["t"], "id", balanced=True, **STUMP).filter("y_pred = 1").count() == 30
    none = fit_forest(rows.withColumn("w", F.when(F.col("id") < 30, 1.0).otherwise(0.0)), "classification", "t", weight="w", **STUMP)
    assert predict(none, rows, ["id"]).select("y_pred").distinct().count() == 1


def test_balancing_refuses_labels_that_are_no_classes(spark, monkeypatch):
    monkeypatch.setattr("molframe.operators.transform.MOST_CLASSES", 3)
    rows = spark.createDataFrame([("a", float(i), 1.0) for i in range(4)], "task string, y double, w double")
    with pytest.raises(ValueError, match="balancing"):
        fit_balancing(rows)
    fit_balancing(rows.filter("y < 3"))


def test_many_feature_vectors_are_not_broadcast(spark, monkeypatch):
    """Neither the join nor the fit leaves the vectors of a large table to the driver or to one task."""
    from molframe.operators import forest

    rows = spark.range(300).selectExpr("id", "array(cast(id % 8 as double), cast(id % 3 as double)) x", "cast(id % 8 as double) y")
    features = forest.dense_features(rows, "x").select("id", forest.FEATURES)
    small = forest.join_features(rows.select("id", "y"), features, 300, "id")
    monkeypatch.setattr(forest, "BROADCAST_ROWS", 299)
    large = forest.join_features(rows.select("id", "y"), features, 300, "id")
    assert "BroadcastHashJoin" not in large._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    monkeypatch.setattr(forest, "AT_ONCE", 20)
    one = features.join(rows.select("id", "y"), "id").coalesce(1)
    assert forest.dealt(one).rdd.getNumPartitions() == 30
    assert forest.dealt(one.limit(0)).count() == 0
    model = forest.fit_forest(one, "regression", trees=1, depth=1, bootstrap=False)
    monkeypatch.setattr(forest, "AT_ONCE", 1 << 23)
    assert forest.dealt(one).rdd.getNumPartitions() == 1
    whole = forest.fit_forest(one, "regression", trees=1, depth=1, bootstrap=False)
    assert model.toDebugString.split("\n")[1:] == whole.toDebugString.split("\n")[1:]
