"""Vector tables as searches need them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.llm.registry import column
from molframe.plans.lineage import cut


def as_bytes(vector: Column) -> Column:
    """The vector as doubles in binary; null if it is null, empty or holds anything but finite numbers."""

    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            made = []
            for v in vectors:
                x = None if v is None else np.asarray(v, dtype=np.float64)
                made.append(x.tobytes() if x is not None and len(x) and np.isfinite(x).all() else None)
            yield pd.Series(made, dtype=object)

    return of(vector)


def matrix(column: pd.Series) -> np.ndarray:
    """Rows of equally long binary vectors."""
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def vector_table(df: DataFrame, id: str, vector: str) -> DataFrame:
    """``vec_id, v`` of the rows that take part, written to the shared folder.

    Rows without id, and vectors that are null, empty, not finite or of another
    length than most, take no part. A repeated id counts once, with its least vector.
    """
    rows = df.select(column(id).alias("vec_id"), as_bytes(column(vector).cast("array<double>")).alias("v"))
    rows = cut(rows.filter("vec_id IS NOT NULL AND v IS NOT NULL").groupBy("vec_id").agg(F.min("v").alias("v")))
    # One row per length reaches the driver's side of this, and one number the driver.
    lengths = rows.groupBy(F.length("v").alias("n")).agg(F.count(F.lit(1)).alias("c"))
    usual = lengths.orderBy(F.desc("c"), "n").limit(1).collect()
    return rows.filter(F.length("v") == (usual[0]["n"] if usual else 0))


def sampled(rows: DataFrame, count: int, id: str = "vec_id") -> np.ndarray:
    """At most ``count`` rows' vectors, the same in every run: those with the least hashes of their ids."""
    some = rows.orderBy(F.xxhash64(id), id).limit(count).select("v").collect()
    return matrix(pd.Series([bytes(r["v"]) for r in some])) if some else np.zeros((0, 1))


def best_first(found: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest scores of each query, ties to the smaller id."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
