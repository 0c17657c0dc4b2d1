"""Cleaning, projections and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.functions.text import normalize_name
from molframe.registry import DatasetSpec


def clean_by_length(df: DataFrame, col: str, max_len: int = 200) -> DataFrame:
    """Keep sequences of at most ``max_len`` characters; missing ones go."""
    return df.filter(F.length(col) <= max_len)


def clean_report(df: DataFrame, col: str, max_len: int, by: Sequence[str]) -> DataFrame:
    """Rows before, kept and removed per group, in one pass."""
    kept = F.count_if(F.length(col) <= max_len)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("original"),
        kept.alias("kept"),
        (F.count(F.lit(1)) - kept).alias("removed"),
    )


def length_losses(df: DataFrame, col: str, max_len: int | None) -> dict[str, int]:
    """How many rows ``clean_by_length`` removes, by reason; without a limit, none."""
    if max_len is None:
        return {}
    counts = df.agg(
        F.count_if(F.col(col).isNull()).alias("missing"), F.count_if(F.length(col) > max_len).alias("too_long")
    )
    return counts.first().asDict()


def missing_labels(df: DataFrame, tasks: Sequence[str]) -> dict[str, int]:
    """Rows without a label, per task, in one pass."""
    return df.agg(*[F.count_if(F.col(f"`{t}`").isNull()).alias(t) for t in tasks]).first().asDict()


def drop_missing(df: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """Drop rows lacking any of the wanted labels."""
    return df.dropna(subset=list(tasks))


def drop_empty_features(df: DataFrame, x: str = "x") -> DataFrame:
    """Drop rows whose feature array is empty or missing."""
    return df.filter(F.size(x) > 0)


def project_tasks(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Id, feature and tasks, in the registry's order."""
    return df.select(spec.id, spec.feature, *[F.col(f"`{t}`") for t in spec.tasks])


def unpivot_tasks(df: DataFrame, id: str | Sequence[str], tasks: Sequence[str]) -> DataFrame:
    """Label matrix to one row per (id, task)."""
    ids = [id] if isinstance(id, str) else list(id)
    return df.unpivot(ids, list(tasks), "task", "y")


def pivot_tasks(df: DataFrame, id: str, tasks: Sequence[str]) -> DataFrame:
    """Back to the matrix; the task list is given, so no extra scan finds it."""
    return df.groupBy(id).pivot("task", list(tasks)).agg(F.first("y"))


def vector_to_columns(df: DataFrame, x: str, n: int, prefix: str = "X") -> DataFrame:
    """Array column to ``n`` wide columns X1 .. Xn."""
    rest = [c for c in df.columns if c != x]
    return df.select(*rest, *[F.get(x, F.lit(i)).alias(f"{prefix}{i + 1}") for i in range(n)])


def columns_to_vector(df: DataFrame, n: int, x: str = "x", prefix: str = "X") -> DataFrame:
    """Wide columns back to one array."""
    wide = [f"{prefix}{i + 1}" for i in range(n)]
    return df.withColumn(x, F.array(*wide)).drop(*wide)


def with_weights(df: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """Add ``w_<task>``: one where the label is known, else zero."""
    return df.withColumns(
        {f"w_{t}": F.when(F.col(f"`{t}`").isNull(), 0.0).otherwise(1.0) for t in tasks}
    )


def normalize_names(df: DataFrame) -> DataFrame:
    """Rename columns: blanks and line continuations become single underscores."""
    return df.toDF(*[" ".join(c.replace("\\\n", " ").split()).replace(" ", "_") for c in df.columns])


def normalized(c: Column) -> Column:
    """The same rule for names held in a column."""
    return normalize_name(c)


def resolve_alias(df: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """Replace aliases (columns ``alias``, ``canonical``) by canonical names."""
    return (
        df.join(aliases, df[name] == aliases["alias"], "left")
        .withColumn("resolved", F.coalesce("canonical", F.col(name)))
        .drop("alias", "canonical")
    )


def split_known(df: DataFrame, registry: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose name is registered, and rows to report."""
    names = registry.select(on).distinct()
    return df.join(names, on, "left_semi"), df.join(names, on, "left_anti")


def nonempty_splits(df: DataFrame, kept: Column, by: Sequence[str]) -> DataFrame:
    """Kept rows per split; splits left with none are dropped."""
    return df.groupBy(*by).agg(F.count_if(kept).alias("n_rows")).filter(F.col("n_rows") > 0)
