"""Counts, summaries and evaluation metrics.

Every metric ignores rows whose truth or prediction is missing and returns one
row per ``by`` group. All but ROC-AUC are single aggregations that combine on
the map side.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.plans.ordered import Running, running, slice_by_range


def total_steps(df: DataFrame, batch: int, workers: int, epochs: int) -> DataFrame:
    """Optimizer steps of a run: rows / batch / workers * epochs, truncated."""
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("n_rows"), (n.cast("double") / batch / workers * epochs).cast("bigint").alias("total_steps")
    )


def dataset_summary(df: DataFrame, tasks: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Rows, labelled rows and positives of each task."""
    columns = [F.count(F.lit(1)).alias("n_rows")]
    for t in tasks:
        columns += [F.count(t).alias(f"n_{t}"), F.count_if(F.col(t) == 1).alias(f"pos_{t}")]
    return df.groupBy(*by).agg(*columns)


def label_stats(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and sample standard deviation of columns."""
    columns = []
    for c in cols:
        columns += [F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}")]
    return df.groupBy(*by).agg(*columns)


def group_sizes(df: DataFrame, key: str) -> DataFrame:
    """Rows per group key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))


def run_summary(scores: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """Repeated runs: mean, population deviation and range."""
    return scores.groupBy(*by).agg(
        F.avg(score).alias("mean"),
        F.stddev_pop(score).alias("std"),
        (F.max(score) - F.min(score)).alias("spread"),
    )


def _known(df: DataFrame, *cols: str) -> DataFrame:
    return df.dropna(subset=list(cols))


def _error(df: DataFrame, y: str, p: str, w: str | None, by: Sequence[str], size: Column, name: str) -> DataFrame:
    weight = F.lit(1.0) if w is None else F.col(w)
    value = F.sum(weight * size) / F.sum(weight)
    return _known(df, y, p).groupBy(*by).agg((F.sqrt(value) if name == "rmse" else value).alias(name))


def rmse(df: DataFrame, y: str, p: str, w: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Root mean squared error, optionally weighted."""
    return _error(df, y, p, w, by, F.pow(F.col(y) - F.col(p), 2), "rmse")


def mse(df: DataFrame, y: str, p: str, w: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Mean squared error; the regression validation loss."""
    return _error(df, y, p, w, by, F.pow(F.col(y) - F.col(p), 2), "mse")


def mae(df: DataFrame, y: str, p: str, w: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute error."""
    return _error(df, y, p, w, by, F.abs(F.col(y) - F.col(p)), "mae")


def regression_errors(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """RMSE, MSE and MAE in one pass."""
    gap = F.col(y) - F.col(p)
    squared = F.avg(F.pow(gap, 2))
    return _known(df, y, p).groupBy(*by).agg(
        F.sqrt(squared).alias("rmse"), squared.alias("mse"), F.avg(F.abs(gap)).alias("mae")
    )


def inverse_linear(c: Column, mean: Column, std: Column) -> Column:
    """Undo a normalization."""
    return c * std + mean


def rmse_denormalized(df: DataFrame, y: str, p: str, mean: str, std: str, by: Sequence[str] = ()) -> DataFrame:
    """RMSE after undoing the normalization of both sides."""
    back = {c: inverse_linear(F.col(c), F.col(mean), F.col(std)) for c in (y, p)}
    return rmse(df.withColumns(back), y, p, by=by)


def pearson_r2(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Squared Pearson correlation; null when either side is constant."""
    return _known(df, y, p).groupBy(*by).agg(F.pow(F.corr(y, p), 2).alias("pearson_r2"))


def accuracy(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of equal labels."""
    return _known(df, y, p).groupBy(*by).agg(
        F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy")
    )


def cross_entropy_of(logits: Column, label: Column) -> Column:
    """Softmax cross-entropy of one row, shifted by the largest logit."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
    return F.log(total) + top - F.get(logits, label)


def cross_entropy(df: DataFrame, logits: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean softmax cross-entropy; the classification validation loss."""
    row = cross_entropy_of(F.col(logits).cast("array<double>"), F.col(label))
    return _known(df, logits, label).groupBy(*by).agg(F.avg(row).alias("cross_entropy"))


def roc_auc(
    df: DataFrame, y: str, p: str, by: Sequence[str] = (), slices: int | None = None
) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; null with one class only.

    Rows shrink to one per distinct score before anything is ordered, and the
    count of lower-scored negatives is a sliced running sum, so one huge task
    with continuous scores still spreads over the cluster.
    """
    scored = (
        _known(df, y, p)
        .groupBy(*by, p)
        .agg(F.count_if(F.col(y) == 1).alias("_pos"), F.count_if(F.col(y) != 1).alias("_neg"))
    )
    sliced = slice_by_range(scored, [p], by, slices, derived=True)
    ranked = running(sliced, _below=Running("sum", F.col("_neg"), inclusive=False))
    wins = F.sum(F.col("_pos") * (F.coalesce("_below", F.lit(0)) + F.col("_neg") / 2.0))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg")
    return ranked.groupBy(*by).agg(
        F.sum(F.col("_pos") + F.col("_neg")).alias("n_rows"),
        F.when(pairs > 0, wins / pairs).alias("roc_auc"),
    )


def task_mean(metric: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean over tasks; tasks without a value do not count."""
    return metric.groupBy(*by).agg(F.avg(value).alias(value), F.count(value).alias("n_tasks"))


def user_metric(
    df: DataFrame, name: str, build: Callable[[Column, Column], Column], y: str, p: str,
    by: Sequence[str] = (), average_over: str | None = None,
) -> DataFrame:
    """A user's metric: ``build`` makes the aggregate from truth and prediction.

    With ``average_over`` the metric is taken per value of that column (a task,
    say) and then averaged.
    """
    groups = [*by, average_over] if average_over else list(by)
    found = _known(df, y, p).groupBy(*groups).agg(build(F.col(y), F.col(p)).alias(name))
    return task_mean(found, name, by) if average_over else found
