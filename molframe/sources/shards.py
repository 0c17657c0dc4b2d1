"""Shard numbers, merged metadata, and which worker reads which shard."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molframe.plans.ordered import row_index


def with_shard(
    df: DataFrame, order: Sequence[str], rows: int = 4096, slices: int | None = None
) -> DataFrame:
    """Shard number of each row when shards of ``rows`` rows follow ``order``."""
    numbered = row_index(df, order, "_idx", slices)
    return numbered.withColumn("shard", F.floor(F.col("_idx") / rows).cast("bigint")).drop("_idx")


def shard_sizes(sharded: DataFrame, *by: str) -> DataFrame:
    """Rows per shard."""
    return sharded.groupBy(*by, "shard").agg(F.count(F.lit(1)).alias("n_rows"))


def shard_shapes(sharded: DataFrame, columns: Sequence[str], *by: str) -> DataFrame:
    """Rows per shard, and ``<column>_shape`` of each column: rows, and for arrays their length.

    Tasks send one row a shard. The length is null where rows of a shard differ
    in it, and for a null array.
    """
    arrays = [c for c in columns if isinstance(sharded.schema[c].dataType, T.ArrayType)]
    ends = [f(F.coalesce(F.size(c), F.lit(-1))).alias(f"_{n}_{c}") for c in arrays for n, f in (("low", F.min), ("high", F.max))]
    sizes = sharded.groupBy(*by, "shard").agg(F.count(F.lit(1)).alias("n_rows"), *ends)

    def shape(c):
        if c not in arrays:
            return F.array("n_rows")
        low, high = F.col(f"_low_{c}"), F.col(f"_high_{c}")
        return F.array(F.col("n_rows"), F.when((low == high) & (low >= 0), low.cast("bigint")))

    return sizes.select(*by, "shard", "n_rows", *[shape(c).alias(f"{c}_shape") for c in columns])


def merge_shards(*parts: DataFrame, shapes: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Merge sharded datasets: rows with global shard numbers, and the shard table with the shapes of named columns.

    Each part has a local ``shard`` column. Only the shard table is ordered and
    numbered; rows stay where they are and look their number up.
    """
    tagged = reduce(
        DataFrame.unionByName, [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    )
    sizes = shard_shapes(tagged, shapes, "part")
    meta = row_index(sizes, ["part", "shard"], "merged_shard", derived=True)
    rows = tagged.join(meta.select("part", "shard", "merged_shard"), ["part", "shard"])
    return rows, meta


def merged_metadata(sharded: DataFrame, part: str) -> DataFrame:
    """The merged shard table alone, for parts marked by a column."""
    return row_index(shard_sizes(sharded, part), [part, "shard"], "merged_shard", derived=True)


def shard_ranges(shards: DataFrame, workers: int, shard: str = "shard") -> DataFrame:
    """Worker of each shard: worker p owns [p*S div P, (p+1)*S div P).

    The owner of shard s is the largest p with ``p*S div P <= s``, in closed
    form ``((s+1)*P - 1) div S``.
    """
    total = shards.agg(F.max(shard) + 1).scalar()
    owner = F.expr(f"((`{shard}` + 1) * {workers} - 1) div _shards")
    return shards.withColumn("_shards", total).withColumn("worker", owner.cast("bigint")).drop("_shards")
