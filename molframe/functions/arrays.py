"""Array helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    A lambda that mentions an expression instead of a bound variable evaluates
    it again for every element, which makes a linear pass quadratic.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def positions(items: Column) -> Column:
    """0 .. size-1, empty for an empty array."""
    return F.transform(items, lambda _, i: i)


def joined(items: Column, separator: str = ",") -> Column:
    """Array of numbers as text."""
    return F.array_join(F.transform(items, lambda v: v.cast("string")), separator)


def one_hot(value: Column, n_classes: int) -> Column:
    """Indicator array of ``value`` over classes 0 .. n_classes-1."""
    return F.array(*[(value == F.lit(k)).cast("int") for k in range(n_classes)])
