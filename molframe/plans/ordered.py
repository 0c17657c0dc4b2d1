"""Running values and row numbers over ordered data without one-task windows.

A window partitioned by a key puts every row of that key into one task, and a
window without a key puts the whole table there. Both fail when one key holds a
third of the data. Here every input, whatever its size, takes the same path:

1. ``slice_by_range`` range-partitions the rows by ``(keys, order)`` and writes
   them with the number of their partition, the slice, as a column. Spark finds
   the boundaries; none passes the driver. The written table fixes the slices,
   so a recomputed partition cannot move a row into another one.
2. ``running`` evaluates an ordinary window inside (keys, slice), and adds what
   the earlier slices of the same key contribute. Rows lie in key order, so
   only a key that ends one slice and begins the next needs such a carry: there
   are fewer of them than slices, and their table is safe to broadcast.

The number of slices is ``spark.sql.shuffle.partitions`` unless given; set it as
for any shuffle, so that a partition fits a task. Inputs must be deterministic,
and ``order`` must be unique within the keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molframe.plans.lineage import cut, scratch_path

SLICE = "_slice"


@dataclass(frozen=True)
class Sliced:
    """Rows in a table that names the slice of each."""

    frame: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def total(self) -> int:
        """Rows in all, from the footers of the table."""
        return self.frame.count()

    def window(self) -> Window:
        return Window.partitionBy(*self.keys, SLICE).orderBy(*self.order)

    def spanning(self) -> DataFrame:
        """Keys whose rows lie in several slices: less than one per slice."""
        key = F.struct(*self.keys)
        ends = self.frame.groupBy(SLICE).agg(F.min(key).alias("first"), F.max(key).alias("last"))
        # One row per slice reaches this window.
        following = F.lead("first").over(Window.orderBy(SLICE))
        torn = ends.select("last", following.alias("next")).filter(F.col("last") == F.col("next"))
        return torn.select(*[F.col("last")[k].alias(f"_key{i}") for i, k in enumerate(self.keys)]).distinct()


@dataclass(frozen=True)
class Running:
    """One running value: ``how`` is sum, count, min, max or last (non-null)."""

    how: str
    value: Column | None = None
    inclusive: bool = True


def slice_by_range(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = (),
    slices: int | None = None,
    derived: bool = False,
) -> Sliced:
    """Write the rows with the number of their value range of ``(keys, order)``.

    ``derived`` says that ``df`` is costly to evaluate, such as an aggregation
    over a whole corpus: it is then written to the shared folder first instead
    of being computed both for the boundaries and for the rows.
    """
    spark = df.sparkSession
    if derived:
        df = cut(df)
    count = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(count, *keys, *order).withColumn(SLICE, F.spark_partition_id())
    path = scratch_path(spark, "slices")
    ranged.write.parquet(path)
    return Sliced(spark.read.schema(ranged.schema).parquet(path), tuple(keys), tuple(order))


def running(sliced: Sliced, **outputs: Running) -> DataFrame:
    """Add one column per output holding its running value."""
    frame = sliced.frame
    window = sliced.window()
    local = {
        name: _local(out, window.rowsBetween(Window.unboundedPreceding, 0 if out.inclusive else -1))
        for name, out in outputs.items()
    }
    carry = _carry(sliced, outputs)
    keys = [f"_key{i}" for i in range(len(sliced.keys))]
    match = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(c)) for k, c in zip(keys, sliced.keys)],
        F.col(SLICE) == F.col("_carry_slice"),
    )
    joined = frame.withColumns({f"_local_{n}": c for n, c in local.items()}).join(
        F.broadcast(carry), match, "left"
    )
    merged = {
        n: _finish(o, _merge(o, F.col(f"_local_{n}"), F.col(f"_carry_{n}"))) for n, o in outputs.items()
    }
    helpers = [f"_{p}_{n}" for n in outputs for p in ("local", "carry")]
    return joined.withColumns(merged).drop(SLICE, "_carry_slice", *keys, *helpers)


def _carry(sliced: Sliced, outputs: dict[str, Running]) -> DataFrame:
    """Per (key, slice): the value over all earlier slices of that key, where there are any."""
    names = [f"_key{i}" for i in range(len(sliced.keys))]
    rows = sliced.frame
    if names:
        match = reduce(
            lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(k)) for n, k in zip(names, sliced.keys)]
        )
        rows = rows.join(F.broadcast(sliced.spanning()), match)
    order = F.struct(*sliced.order)
    summary = rows.groupBy(SLICE, *names).agg(
        *[_summary(o, order).alias(f"_sum_{n}") for n, o in outputs.items()]
    )
    # At most two rows per slice reach this window, whatever the input size.
    before = Window.partitionBy(*names).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return summary.select(
        F.col(SLICE).alias("_carry_slice"),
        *names,
        *[_over(o, F.col(f"_sum_{n}"), before).alias(f"_carry_{n}") for n, o in outputs.items()],
    )


def _measured(out: Running) -> Column:
    return F.lit(1) if out.value is None else out.value


def _local(out: Running, window) -> Column:
    if out.how == "count":
        return F.count(_measured(out)).over(window)
    return _over(out, out.value, window)


def _over(out: Running, value: Column, window) -> Column:
    if out.how in ("sum", "count"):
        return F.sum(value).over(window)
    if out.how == "min":
        return F.min(value).over(window)
    if out.how == "max":
        return F.max(value).over(window)
    if out.how == "last":
        return F.last(value, ignorenulls=True).over(window)
    raise ValueError(f"unknown running value {out.how!r}")


def _summary(out: Running, order: Column) -> Column:
    if out.how == "count":
        return F.count(_measured(out))
    if out.how == "last":
        return F.max_by(out.value, F.when(out.value.isNotNull(), order))
    return {"sum": F.sum, "min": F.min, "max": F.max}[out.how](out.value)


def _merge(out: Running, here: Column, earlier: Column) -> Column:
    if out.how in ("sum", "count"):
        # Either side may be empty; both empty stays null.
        return F.coalesce(here + earlier, here, earlier)
    if out.how == "min":
        return F.least(here, earlier)
    if out.how == "max":
        return F.greatest(here, earlier)
    return F.coalesce(here, earlier)


def _finish(out: Running, value: Column) -> Column:
    return F.coalesce(value, F.lit(0).cast("bigint")) if out.how == "count" else value


def row_index(
    df: DataFrame,
    order: Sequence[str],
    name: str = "idx",
    slices: int | None = None,
    derived: bool = False,
) -> DataFrame:
    """Zero-based position of every row in the global order of ``order``."""
    return indexed(slice_by_range(df, order, (), slices, derived), name)


def indexed(sliced: Sliced, name: str = "idx") -> DataFrame:
    """As ``row_index`` for rows already sliced; ``sliced.total`` is then known too."""
    frame = running(sliced, **{name: Running("count")})
    return frame.withColumn(name, F.col(name) - 1)
