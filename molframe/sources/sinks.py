"""Writers. Every one states what happens when the target exists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLITS = ("train", "valid", "test")


def write_blocks(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Selected columns as array blocks; the rest is never computed."""
    (df.select(*columns) if columns else df).write.mode("errorifexists").parquet(path)


def write_shards(df: DataFrame, path: str, rows: int = 4096) -> None:
    """Files of at most ``rows`` rows."""
    df.write.mode("errorifexists").option("maxRecordsPerFile", rows).parquet(path)


def write_new(df: DataFrame, path: str) -> None:
    """Refuse to write into an existing target."""
    df.write.mode("errorifexists").parquet(path)


def write_if_absent(df: DataFrame, path: str) -> None:
    """Leave an existing target as it is."""
    df.write.mode("ignore").parquet(path)


def write_splits(df: DataFrame, path: str, format: str = "parquet") -> None:
    """One folder per split: readers of one split skip the other files."""
    writer = df.write.mode("errorifexists").partitionBy("split")
    if format == "csv":
        writer.options(header=True, quote='"', escape='"').csv(path)
    else:
        writer.format(format).save(path)


def append_metrics(df: DataFrame, path: str) -> None:
    """Add rows to a metrics table."""
    df.write.mode("append").parquet(path)


def write_vocab(df: DataFrame, path: str) -> None:
    """Vocabulary as JSON lines, split over files."""
    df.select("token", "n", F.col("token_id")).write.mode("errorifexists").json(path)
