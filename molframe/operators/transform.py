"""Label transformers on long rows ``(id, task, y, w)``: fit on train, apply, invert.

Fitted statistics have one row per task, or for balancing per task and class, at
most MOST_CLASSES: bounded whatever the rows, so they are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Classes of all tasks together that balancing knows.
MOST_CLASSES = 10_000


@dataclass(frozen=True)
class Fitted:
    """A fitted transformer: optional statistics plus forward and inverse expressions."""

    name: str
    stats: DataFrame | None
    keys: tuple[str, ...]
    forward: Mapping[str, Column]
    inverse: Mapping[str, Column] | None

    def _attached(self, df: DataFrame) -> DataFrame:
        return df if self.stats is None else attach_stats(df, self.stats, self.keys)

    def _finished(self, df: DataFrame, like: DataFrame, changes: Mapping[str, Column]) -> DataFrame:
        return df.withColumns(dict(changes)).select(*like.columns)

    def apply(self, df: DataFrame) -> DataFrame:
        return self._finished(self._attached(df), df, self.forward)

    def invert(self, df: DataFrame) -> DataFrame:
        if self.inverse is None:
            raise ValueError(f"{self.name} cannot be inverted")
        return self._finished(self._attached(df), df, self.inverse) if self.inverse else df


def attach_stats(df: DataFrame, stats: DataFrame, on: Sequence[str] = ("task",)) -> DataFrame:
    """Fitted statistics next to each row of the task."""
    return df.join(F.broadcast(stats), list(on), "left")


def _labelled(train: DataFrame) -> DataFrame:
    return train.filter(F.col("y").isNotNull() & (F.col("w") > 0))


def fit_normalization(train: DataFrame) -> Fitted:
    """(y - mean) / population deviation; a constant task is only centred."""
    sigma = F.stddev_pop("y")
    stats = _labelled(train).groupBy("task").agg(
        F.avg("y").alias("_mu"), F.when(sigma == 0, 1.0).otherwise(sigma).alias("_sigma")
    )
    y = F.col("y")
    return Fitted(
        "normalization", stats, ("task",),
        {"y": (y - F.col("_mu")) / F.col("_sigma")},
        {"y": y * F.col("_sigma") + F.col("_mu")},
    )


def fit_minmax(train: DataFrame) -> Fitted:
    """(y - min) / (max - min); a constant task becomes 0."""
    width = F.max("y") - F.min("y")
    stats = _labelled(train).groupBy("task").agg(
        F.min("y").alias("_low"), F.when(width == 0, 1.0).otherwise(width).alias("_width")
    )
    y = F.col("y")
    return Fitted(
        "minmax", stats, ("task",),
        {"y": (y - F.col("_low")) / F.col("_width")},
        {"y": y * F.col("_width") + F.col("_low")},
    )


def fit_clipping(train: DataFrame, limit: float = 5.0) -> Fitted:
    """Clamp to [-limit, limit]; missing labels stay missing."""
    y = F.col("y")
    clamped = F.when(y.isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), y)))
    return Fitted("clipping", None, (), {"y": clamped}, None)


def fit_log(train: DataFrame) -> Fitted:
    """ln(1 + y)."""
    return Fitted("log", None, (), {"y": F.log1p("y")}, {"y": F.expm1("y")})


def fit_balancing(train: DataFrame) -> Fitted:
    """Weights that give each class of a task the same total; labels are untouched.

    One row per class is broadcast, so labels that are no classes are refused.
    """
    per_class = _labelled(train).groupBy("task", "y").agg(F.count(F.lit(1)).alias("_n"))
    many = per_class.limit(MOST_CLASSES + 1).count()
    if many > MOST_CLASSES:
        raise ValueError(f"balancing is for classes; there are more than {MOST_CLASSES} distinct labels")
    totals = per_class.groupBy("task").agg(F.sum("_n").alias("_total"))
    stats = per_class.join(totals, "task").select("task", "y", (F.col("_total") / F.col("_n")).alias("_balance"))
    return Fitted("balancing", stats, ("task", "y"), {"w": F.coalesce("_balance", F.lit(0.0))}, {})


TRANSFORMERS: dict[str, Callable[..., Fitted]] = {
    "normalization": fit_normalization,
    "minmax": fit_minmax,
    "clipping": fit_clipping,
    "log": fit_log,
    "balancing": fit_balancing,
}


def fit(name: str, train: DataFrame, **params) -> Fitted:
    """Fit by name, whatever its case."""
    return TRANSFORMERS[name.lower()](train, **params)


@dataclass(frozen=True)
class Chain:
    """Transformers applied in order and inverted in reverse order."""

    steps: tuple[Fitted, ...]

    def apply(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.apply(df)
        return df

    def invert(self, df: DataFrame) -> DataFrame:
        for step in reversed(self.steps):
            df = step.invert(df)
        return df


def fit_chain(names: Sequence[str | Callable[[DataFrame], Fitted]], train: DataFrame) -> Chain:
    """Fit every step on the raw training rows; a callable is a user's own fit function."""
    return Chain(tuple(fit(n, train) if isinstance(n, str) else n(train) for n in names))


def save_chain(chain: Chain, path: str) -> None:
    """Write the statistics of each step, by its place in the chain."""
    for i, step in enumerate(chain.steps):
        if step.stats is not None:
            step.stats.write.mode("errorifexists").parquet(f"{path}/step={i}")


def load_chain(spark: SparkSession, names: Sequence[str], path: str) -> Chain:
    """A chain of these steps with the statistics that ``save_chain`` wrote."""
    none = spark.createDataFrame([], "task string, y double, w double")
    unfitted = [fit(name, none) for name in names]
    return Chain(tuple(
        step if step.stats is None else replace(step, stats=spark.read.parquet(f"{path}/step={i}"))
        for i, step in enumerate(unfitted)
    ))
