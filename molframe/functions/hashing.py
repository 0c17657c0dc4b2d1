"""Deterministic hashes. md5-based, so any SQL engine can recompute them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UINT32 = 4294967296.0


def hash32(value: Column, word: int = 0) -> Column:
    """The ``word``-th 32 bits of md5(value) as a bigint; words 0 to 3."""
    return F.conv(F.substring(F.md5(value), 8 * word + 1, 8), 16, 10).cast("bigint")


def hash60(value: Column) -> Column:
    """The first 60 bits of md5(value): always a non-negative bigint."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("bigint")


def unit_hash(value: Column, word: int = 0) -> Column:
    """Uniform value in [0, 1)."""
    return hash32(value, word) / F.lit(UINT32)


def seeded(seed: int, *parts: Column) -> Column:
    """Text to hash: seed and parts, separated."""
    return F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
