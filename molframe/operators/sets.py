"""Unions, overlaps, mixtures and subsets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molframe.functions.hashing import hash32, seeded, unit_hash
from molframe.plans.ordered import row_index

CELLS = 65_536


def union_parts(*parts: DataFrame) -> DataFrame:
    """Concatenate parts by column name."""
    return reduce(DataFrame.unionByName, parts)


def id_overlap(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Ids present in both."""
    return a.select(on).intersect(b.select(on))


def mixture(parts: Sequence[tuple[DataFrame, float]], id: str, seed: int = 0) -> DataFrame:
    """A hash-chosen fraction of each part, concatenated."""
    key = seeded(seed, F.col(id))
    return union_parts(
        *[df if fraction >= 1.0 else df.filter(unit_hash(key) < fraction) for df, fraction in parts]
    )


def subset_exact(
    df: DataFrame, id: str, n: int, seed: int = 0, slices: int | None = None
) -> DataFrame:
    """Exactly ``n`` rows: those with the smallest (hash, id).

    A histogram over 65,536 hash cells finds the cell in which the n-th row
    lies. Whole cells below it are taken by a plain filter; only that one cell
    is ordered. No global sort, no single-task limit.
    """
    cell = F.floor(hash32(seeded(seed, F.col(id))) / CELLS).cast("int")
    hashed = df.withColumn("_cell", cell)
    sizes = hashed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"))
    # At most 65,536 rows, whatever the size of the data.
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    filled = sizes.select("_cell", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    edge = filled.filter((F.col("before") <= n) & (F.col("before") + F.col("n") > n)).first()
    if edge is None:
        return df
    whole = hashed.filter(F.col("_cell") < edge["_cell"])
    border = hashed.filter(F.col("_cell") == edge["_cell"]).withColumn("_h", hash32(seeded(seed, F.col(id))))
    picked = row_index(border, ["_h", id], "_idx", slices).filter(F.col("_idx") < n - edge["before"])
    return whole.unionByName(picked.drop("_h", "_idx")).drop("_cell")
