"""Splits, partitions and their audit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molframe.functions.hashing import hash60, seeded, unit_hash
from molframe.operators.scaffold import element, plain_kind, two_core
from molframe.plans.lineage import cut
from molframe.plans.ordered import Running, indexed, row_index, running, slice_by_range


def group_split(
    df: DataFrame,
    key: str,
    fractions: tuple[int, int, int] = (8, 1, 1),
    slices: int | None = None,
) -> DataFrame:
    """Add ``split`` so that rows sharing ``key`` share a split.

    Groups are taken largest first (key ascending among equals). A group goes
    to train while it fits under the train share, else to valid while it fits
    under train plus valid, else to test.
    """
    groups = group_assignment(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, fractions, slices)
    assigned = groups.select(F.col(key).alias("_key"), "split")
    # A huge group makes a skewed join key; the group side is unique, so AQE can split it.
    return df.join(assigned, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def group_assignment(
    groups: DataFrame, key: str, fractions: tuple[int, int, int] = (8, 1, 1), slices: int | None = None
) -> DataFrame:
    """Split of each group, from one row ``(key, n)`` per group.

    The greedy fill walks the groups by (size descending, key) and changes its
    mind only where one stops fitting or a smaller one fits again: at most some
    dozens of times, since what is left of a share halves each time. The driver
    sees those turning points alone. Groups are ranked only inside the sizes
    that a turning point cuts.
    """
    groups = cut(groups)
    turns = fill_turns(groups, fractions, slices)
    torn = sorted({t.size for t in turns if t.before})
    place = F.lit(0).cast("bigint")
    if torn:
        inside = groups.filter(F.col("n").isin(torn))
        ranked = running(slice_by_range(inside, [key], ["n"], slices), _place=Running("count"))
        whole = groups.filter(~F.col("n").isin(torn)).withColumn("_place", F.lit(1).cast("bigint"))
        groups = whole.unionByName(ranked)
        place = F.col("_place") - 1
    split = F.lit(None).cast("string")
    for t in turns:
        reached = (F.col("n") < t.size) | ((F.col("n") == t.size) & (place >= t.before))
        split = F.when(reached, t.split).otherwise(split)
    return groups.select(key, "n", split.alias("split"))


@dataclass(frozen=True)
class Turn:
    """From group number ``before`` of this size on (and in smaller sizes), groups go to ``split``."""

    size: int
    before: int
    split: str


#: Distinct sizes up to this one are walked at the driver: there cannot be more of them.
SMALL_SIZES = 1024


def fill_turns(
    groups: DataFrame, fractions: tuple[int, int, int], slices: int | None = None, small: int = SMALL_SIZES
) -> list[Turn]:
    """Turning points of the greedy fill.

    Among sizes above ``small`` each is found by one aggregate over running sums
    of the sizes; the others are at most ``small`` rows.
    """
    sizes = groups.groupBy("n").agg(F.count(F.lit(1)).alias("k")).withColumn("rows", F.col("n") * F.col("k"))
    known = (
        sizes.groupBy(F.least("n", F.lit(small + 1)).alias("class"))
        .agg(F.sum("rows").alias("rows"), F.max("n").alias("n"))
        .sort(F.desc("class"))
        .collect()
    )
    if not known:
        return []
    upto, walked, summed = 0, [], None
    for r in known:
        upto += r["rows"]
        if r["class"] <= small:
            walked.append((r["n"], r["rows"], upto))
    if len(walked) < len(known):
        large = sizes.filter(F.col("n") > small).withColumn("_larger", -F.col("n"))
        summed = cut(running(slice_by_range(large, ["_larger"], (), slices), upto=Running("sum", F.col("rows"))))

    def first(size: int, changes) -> tuple[int, int, int] | None:
        """The largest size from ``size`` down at which ``changes(size, upto)`` holds, with its rows and their running sum."""
        if summed is not None and size > small:
            here = (F.col("n") <= size) & changes(F.col("n"), F.col("upto"))
            found = summed.filter(here).agg(F.max_by(F.struct("n", "rows", "upto"), "n")).first()[0]
            if found is not None:
                return tuple(found)
        return next((w for w in walked if w[0] <= size and changes(w[0], w[2])), None)

    whole = sum(fractions)
    train = upto * fractions[0] // whole
    valid = upto * (fractions[0] + fractions[1]) // whole
    turns: list[Turn] = []
    # The next group is number ``before`` of size ``n``; ``done`` rows lie in front of it.
    n, before, done = known[0]["n"], 0, 0
    while True:
        if n <= train:
            split, found = "train", first(n, lambda size, end: end > done + train)
        elif n <= valid:
            split = "valid"
            found = first(n, lambda size, end: (end > done + valid) | ((size <= train) & (size < n)))
        else:
            split, found = "test", first(n, lambda size, end: size <= max(train, valid))
        turns.append(Turn(n, before, split))
        if found is None:
            return turns
        size, rows, end = found
        left = train if split == "train" else valid if split == "valid" and size > train else 0
        before = (done + left - (end - rows)) // size if left else 0
        n, reached = size, end - rows + before * size
        if split != "test":
            # Both shares are counted from the first row: train leaves less for valid too.
            valid -= reached - done
            train -= reached - done if split == "train" else 0
        done = reached


def hash_split(
    df: DataFrame, id: str, seed: int = 0, fractions: tuple[int, int, int] = (8, 1, 1)
) -> DataFrame:
    """Random split that depends on the id and seed only."""
    u = unit_hash(seeded(seed, F.col(id)))
    whole = sum(fractions)
    train, valid = fractions[0] / whole, (fractions[0] + fractions[1]) / whole
    return df.withColumn("split", F.when(u < train, "train").when(u < valid, "valid").otherwise("test"))


def no_split(df: DataFrame) -> DataFrame:
    """Everything is training data."""
    return df.withColumn("split", F.lit("train"))


def contiguous_parts(
    df: DataFrame, order: Sequence[str], n: int, slices: int | None = None
) -> DataFrame:
    """Part 0 .. n-1 of each row; sizes differ by at most one and no row is dropped."""
    sliced = slice_by_range(df, order, (), slices)
    total = max(sliced.total, 1)
    return indexed(sliced, "_idx").withColumn("part", F.expr(f"(_idx * {n}) div {total}")).drop("_idx")


def worker_shard(
    df: DataFrame, order: Sequence[str], workers: int, slices: int | None = None
) -> DataFrame:
    """Round-robin worker of each row."""
    numbered = row_index(df, order, "_idx", slices)
    return numbered.withColumn("worker", F.pmod("_idx", F.lit(workers))).drop("_idx")


def minibatches(
    df: DataFrame, order: Sequence[str], size: int, slices: int | None = None
) -> DataFrame:
    """Batch number and place in the batch of each row; the last batch may be short."""
    numbered = row_index(df, order, "_idx", slices)
    return numbered.withColumns(
        {
            "batch_id": F.floor(F.col("_idx") / size).cast("bigint"),
            "in_batch": F.pmod("_idx", F.lit(size)).cast("bigint"),
        }
    ).drop("_idx")


def audit_split(df: DataFrame, id: str, key: str) -> DataFrame:
    """One row of leak counts: ids in several splits, groups in several splits, rows without one."""
    def torn(by):
        per = df.groupBy(by).agg((F.min("split") != F.max("split")).alias("torn"))
        return per.agg(F.count_if("torn")).scalar()

    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("split").isNull()).alias("n_unassigned"),
    ).withColumns({"ids_in_many": torn(id), "groups_in_many": torn(key)})


def graph_key(bonds: DataFrame, atoms: DataFrame) -> DataFrame:
    """Coarse group key of each molecule: an order-free digest of its typed two-core bonds.

    Atoms count by element and aromatic spelling only, so molecules that differ
    in stereo marks, charges, isotopes or written hydrogens share a key, and so
    do two ways of writing the bond between aromatic rings. The digest is of
    bonds, not of their places: scaffolds with the same bonds also share one
    (``scaffold.scaffold_key`` tells them apart).

    Bond hashes are summed and xor-ed, so a molecule of any size is combined
    bond by bond and never collected. Acyclic molecules get the empty key.
    """
    symbols = atoms.select("mol", "pos", element(F.col("symbol")).alias("symbol"))
    core = two_core(bonds)
    typed = core.join(symbols.toDF("mol", "src", "s1"), ["mol", "src"]).join(
        symbols.toDF("mol", "dst", "s2"), ["mol", "dst"]
    )
    bond = hash60(F.concat_ws("|", F.least("s1", "s2"), F.greatest("s1", "s2"), plain_kind(F.col("kind"), F.col("s1"), F.col("s2"))))
    digest = typed.groupBy("mol").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(bond).alias("x"),
        F.sum(F.pmod(bond, F.lit(1 << 31))).alias("s"),
    )
    keyed = digest.select("mol", F.md5(F.concat_ws(":", "n", "x", "s")).alias("group_key"))
    molecules = atoms.select("mol").distinct()
    return molecules.join(keyed, "mol", "left").select("mol", F.coalesce("group_key", F.lit("")).alias("group_key"))
