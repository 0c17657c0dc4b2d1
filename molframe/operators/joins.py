"""Joins. Small sides are left to the optimizer's size check; skewed sides to AQE."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molframe.plans.lineage import cut, partitions


def attach_labels(df: DataFrame, labels: DataFrame, on: str) -> DataFrame:
    """Left join of labels on id: unknown labels stay null."""
    return df.join(labels, on, "left")


def align(preds: DataFrame, truth: DataFrame, on: Sequence[str]) -> DataFrame:
    """Predictions next to the truth, matched by key instead of file order."""
    return preds.join(truth, list(on), "inner")


def with_registry(df: DataFrame, registry: DataFrame, on: str) -> DataFrame:
    """Look rows up in a registry."""
    return df.join(registry, on, "inner")


def experiment_grid(
    datasets: DataFrame,
    sources: Sequence[str],
    params: Mapping[str, Any],
    overrides: DataFrame | None = None,
    on: str = "dataset",
) -> DataFrame:
    """Each dataset with each pretraining source and its parameters.

    ``overrides`` holds one row per dataset with some of the parameter columns;
    where it has a value, that value replaces the default.
    """
    grid = datasets.withColumn("source", F.explode(F.array(*[F.lit(s) for s in sources])))
    if overrides is None:
        return grid.withColumns({k: F.lit(v) for k, v in params.items()})
    replaced = [c for c in overrides.columns if c != on]
    renamed = overrides.select(on, *[F.col(c).alias(f"_{c}") for c in replaced])
    grid = grid.join(renamed, on, "left")
    chosen = {
        k: F.coalesce(F.col(f"_{k}"), F.lit(v)) if k in replaced else F.lit(v) for k, v in params.items()
    }
    return grid.withColumns(chosen).drop(*[f"_{c}" for c in replaced])


def two_way(bonds: DataFrame) -> DataFrame:
    """Each bond in both directions, without a second scan."""
    def arc(a, b):
        return F.struct(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b"))

    return bonds.select("mol", F.inline(F.array(arc("src", "dst"), arc("dst", "src"))))


#: Bonds of one atom that meet each other in one task.
GRID = 1024


def pairs_within_2(bonds: DataFrame, grid: int = GRID) -> DataFrame:
    """Node pairs at graph distance 1 or 2, each once with u < v.

    The two-hop join is keyed by (molecule, middle node, cell). The bonds of a
    middle node of more than ``grid`` are dealt by hash into as many blocks as it
    has times ``grid``, and each pair of blocks is a cell of its own: a cell sees
    about ``grid`` bonds from either side whatever the degree. Other nodes are one
    cell. The output, about half the degree squared for each node, is what was
    asked for.
    """
    bonds = cut(bonds.select("mol", "src", "dst"))
    rows = 2 * bonds.count()
    arcs = two_way(bonds)
    one = arcs.filter("a < b").select("mol", F.col("a").alias("u"), F.col("b").alias("v"), F.lit(1).alias("distance"))
    # At most one row for every ``grid`` bonds.
    hubs = arcs.groupBy("mol", "a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > grid)
    hubs = cut(hubs.select("mol", F.col("a").alias("mid"), F.ceil(F.col("n") / grid).cast("int").alias("blocks")))
    ends = arcs.select("mol", F.col("a").alias("mid"), F.col("b").alias("end")).join(hubs, ["mol", "mid"], "left")
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = ends.select("mol", "mid", "end", blocks.alias("blocks"), F.pmod(F.xxhash64("end"), blocks).cast("int").alias("block"))
    left = dealt.select("mol", "mid", F.col("end").alias("x"), F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    right = dealt.select("mol", "mid", F.col("end").alias("y"), F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), "block")).alias("i"))
    # What the cells hold and what they give: two rows at least for each arc.
    cells, pairs = partitions(bonds, rows), partitions(bonds, 2 * rows)
    key = ["mol", "mid", "i", "j"]
    left, right = left.repartition(cells, *key), right.repartition(cells, *key)
    met = left.join(right, ["mol", "mid", "i", "j"]).filter("x < y OR (i < j AND x <> y)")
    two = met.select("mol", F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"), F.lit(2).alias("distance"))
    return one.unionByName(two).repartition(pairs, "mol", "u", "v").groupBy("mol", "u", "v").agg(F.min("distance").alias("distance"))
