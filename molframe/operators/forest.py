"""Random-forest baseline on Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from math import ceil

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molframe.operators.metrics import rmse, roc_auc, run_summary
from molframe.operators.transform import Chain, fit_balancing
from molframe.plans.lineage import cut

FEATURES = "_features"
#: Feature values that a task holds when trees are fitted, at four bytes each.
AT_ONCE = 1 << 23
#: Rows of features that may be broadcast: a sparse vector has some hundred bytes, which no size estimate of Spark's counts.
BROADCAST_ROWS = 50_000


def dense_features(df: DataFrame, x: str) -> DataFrame:
    """Feature vector from an array of numbers."""
    return df.withColumn(FEATURES, array_to_vector(F.col(x).cast("array<double>")))


def bit_features(df: DataFrame, bits: str, size: int) -> DataFrame:
    """Sparse feature vector from an array of set bits."""
    named = df.withColumn("_bits", F.col(bits).cast("array<string>"))
    model = CountVectorizerModel.from_vocabulary(
        [str(i) for i in range(size)], inputCol="_bits", outputCol=FEATURES
    ).setBinary(True)
    return model.transform(named).drop("_bits")


def join_features(labels: DataFrame, features: DataFrame, rows: int, on: str) -> DataFrame:
    """Labels next to feature vectors of ``rows`` rows, which are broadcast only if they are few."""
    return labels.join(features if rows <= BROADCAST_ROWS else features.hint("merge"), on)


def dealt(train: DataFrame) -> DataFrame:
    """Rows in as many partitions as bound what a task holds while trees are fitted; ``train`` should be a table."""
    one = train.select(FEATURES).first()
    parts = ceil(train.count() * one[0].size / AT_ONCE) if one and one[0] is not None else 0
    return train.repartition(parts) if parts > train.rdd.getNumPartitions() else train


def forest(
    kind: str,
    label: str = "y",
    seed: int = 0,
    trees: int = 100,
    depth: int = 10,
    bootstrap: bool = True,
    criterion: str | None = None,
    min_samples_split: int = 2,
    weight: str | None = None,
    feature_subset: str | None = None,
) -> Estimator:
    """Estimator by kind: ``classification`` or ``regression``.

    Spark bounds rows per child, not per split; half the split size is its
    nearest setting. Regression considers all features at each split,
    classification as many as Spark takes by itself, unless ``feature_subset``
    says otherwise. ``weight`` names a column of row weights. One tree of depth 1
    without bootstrap over all features is the decision stump of the best split.
    """
    if depth > 30:
        raise ValueError(f"a depth of {depth} is more than the 30 that Spark can do")
    common = dict(
        featuresCol=FEATURES, labelCol=label, predictionCol="y_pred", numTrees=trees, maxDepth=depth,
        minInstancesPerNode=max(1, min_samples_split // 2), bootstrap=bootstrap, seed=seed,
        featureSubsetStrategy=feature_subset or ("auto" if kind == "classification" else "all"),
        **({"weightCol": weight} if weight else {}),
    )
    if kind == "classification":
        return RandomForestClassifier(
            impurity=criterion or "gini", probabilityCol="_probability", rawPredictionCol="_raw", **common
        )
    return RandomForestRegressor(impurity=criterion or "variance", **common)


def fit_forest(train: DataFrame, kind: str, label: str = "y", **params) -> Model:
    """Fit on labelled rows; with a ``weight`` column, on those of positive weight."""
    known = train.filter(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double"))
    if params.get("weight"):
        known = known.filter(F.col(params["weight"]) > 0)
    return forest(kind, label, **params).fit(dealt(known))


#: A forest of one tree with one exact split.
STUMP = {"trees": 1, "depth": 1, "bootstrap": False, "feature_subset": "all"}


def predict(model: Model, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Predictions table: kept columns, ``y_pred`` and, for two or more classes, ``score`` of class 1."""
    out = model.transform(df)
    columns = [*keep, "y_pred"]
    if "_probability" in out.columns:
        out = out.withColumn("score", F.get(vector_to_array("_probability"), F.lit(1)))
        columns.append("score")
    return out.select(*columns)


def fit_tasks(df: DataFrame, tasks: Sequence[str], id: str, balanced: bool = False, **params) -> DataFrame:
    """One forest per task on its labelled rows; predictions for all rows in long form.

    ``balanced`` weighs the classes of each task alike, by the training rows.
    """
    features = cut(df)
    parts = []
    for task in tasks:
        train = features.filter("split = 'train'")
        if balanced:
            long = train.withColumns({"task": F.lit(task), "y": F.col(task), "w": F.lit(1.0)})
            train, params["weight"] = fit_balancing(long).apply(long), "w"
        model = fit_forest(train, "classification", task, **params)
        parts.append(
            predict(model, features, [id, "split", task])
            .withColumnRenamed(task, "y")
            .withColumn("task", F.lit(task))
        )
    return reduce(DataFrame.unionByName, parts)


def evaluate(
    model: Model, df: DataFrame, kind: str, by: Sequence[str] = ("split",), chain: Chain | None = None
) -> DataFrame:
    """ROC-AUC or RMSE per group; regression labels are transformed back first."""
    if kind == "classification":
        return roc_auc(predict(model, df, [*by, "y"]), "y", "score", by).select(*by, F.col("roc_auc").alias("score"))
    scored = predict(model, df, [*by, "id", "task", "y", "w"])
    if chain is not None:
        # The inverse works on ``y``: first the truth, then the prediction in its place.
        swap = {"y": "_truth", "y_pred": "y"}
        back = chain.invert(chain.invert(scored).withColumnsRenamed(swap))
        scored = back.withColumnsRenamed({"y": "y_pred", "_truth": "y"})
    return rmse(scored, "y", "y_pred", by=by).select(*by, F.col("rmse").alias("score"))


def run_repeated(
    df: DataFrame, kind: str, seeds: Sequence[int] = (0, 1, 2), chain: Chain | None = None,
    build: Callable[[int], Estimator] | None = None, **params,
) -> tuple[DataFrame, DataFrame]:
    """One fit per seed on the train split: scores per run and split, and their summary.

    Rows are fitted with their weight ``w``, as the chain leaves it. ``build`` may return any Spark ML estimator for a seed instead of the forest.
    """
    data = cut(chain.apply(df) if chain is not None else df)
    train = data.filter("split = 'train'")
    runs = []
    for seed in seeds:
        known = train.filter("y is not null")
        model = build(seed).fit(known) if build else fit_forest(train, kind, seed=seed, weight="w", **params)
        held = data.filter("split <> 'train'")
        runs.append(evaluate(model, held, kind, chain=chain).withColumn("run", F.lit(seed)))
    scores = reduce(DataFrame.unionByName, runs)
    return scores, run_summary(scores, ["split"])


def save(model: Model, path: str) -> None:
    """Write a fitted forest."""
    model.write().overwrite().save(path)


def load(path: str, kind: str) -> Model:
    """Read a fitted forest back."""
    reader = RandomForestClassificationModel if kind == "classification" else RandomForestRegressionModel
    return reader.load(path)
