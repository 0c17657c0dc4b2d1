"""Places of regular-expression matches, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from molframe.functions.arrays import let

BLOCK = 512


def prefix_sums(values: Column) -> Column:
    """For each element the sum of those before it, as bigint.

    Sums are folded block by block: appending to an array copies it, which on a
    whole long array would make the fold quadratic.
    """

    def of(items):
        n = F.size(items)
        starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(BLOCK))
        blocks = F.transform(starts, lambda s: F.slice(items, s, BLOCK))

        def inside(total, block):
            first = F.struct(total.alias("total"), F.array().cast("array<bigint>").alias("sums"))
            return F.aggregate(
                block,
                first,
                lambda s, v: F.struct(
                    (s["total"] + v).alias("total"), F.concat(s["sums"], F.array(s["total"])).alias("sums")
                ),
            )

        def add(state, block):
            return let(
                inside(state["total"], block),
                lambda r: F.struct(
                    r["total"].alias("total"), F.concat(state["parts"], F.array(r["sums"])).alias("parts")
                ),
            )

        empty = F.struct(
            F.lit(0).cast("bigint").alias("total"), F.array().cast("array<array<bigint>>").alias("parts")
        )
        return F.flatten(F.aggregate(blocks, empty, add)["parts"])

    return let(values, of)


def matches(text: Column, pattern: Column, group: int, measure) -> Column:
    """array<struct(start, end, value)> of all leftmost, non-overlapping matches.

    ``measure`` gives the extent of a piece of text (its characters, its words).
    Matches and the pieces between them alternate and make up the whole text,
    so their extents add up to the places. ``value`` is the given group.
    """
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(group)) if group else whole
    gaps = F.transform(F.split(text, pattern, -1), lambda g: measure(g).cast("bigint"))
    lengths = F.transform(whole, lambda m: measure(m).cast("bigint"))

    def placed(gap, length):
        steps = F.zip_with(F.slice(gap, F.lit(1), F.size(length)), length, lambda g, m: g + m)
        return F.zip_with(prefix_sums(steps), gap, lambda before, g: before + g)

    def build(gap):
        return let(
            lengths,
            lambda length: F.zip_with(
                F.slice(placed(gap, length), F.lit(1), F.size(length)),
                F.arrays_zip(length.alias("length"), value.alias("value")),
                lambda start, m: F.struct(
                    start.alias("start"), (start + m["length"]).alias("end"), m["value"].alias("value")
                ),
            ),
        )

    return F.filter(let(gaps, build), lambda m: m["start"].isNotNull() & m["end"].isNotNull())
