"""Sliced running values against plain Python, with one key holding a third of the rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from molframe.plans.ordered import Running, row_index, running, slice_by_range


def make_rows(seed, n=600):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.34 else rng.choice([None, "a", "b", "c", "d"])
        value = None if rng.random() < 0.2 else round(rng.uniform(-5, 5), 3)
        rows.append((key, i * 7 % n, value))
    rng.shuffle(rows)
    return rows


def expected(rows):
    out = {}
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    for key, members in groups.items():
        members.sort(key=lambda r: r[1])
        for i, (_, order, _) in enumerate(members):
            upto = [r[2] for r in members[: i + 1] if r[2] is not None]
            before = [r[2] for r in members[:i] if r[2] is not None]
            out[(key, order)] = (
                i + 1,
                round(sum(upto), 6) if upto else None,
                min(before) if before else None,
                max(upto) if upto else None,
                before[-1] if before else None,
            )
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("slices", [1, 6, 40])
def test_running_equals_brute_force(spark, seed, slices):
    rows = make_rows(seed)
    df = spark.createDataFrame(rows, "key string, ord bigint, v double")
    sliced = slice_by_range(df, ["ord"], ["key"], slices)
    assert sliced.frame.select("_slice").distinct().count() <= slices and sliced.total == len(rows)
    v = F.col("v")
    got = running(
        sliced,
        n=Running("count"),
        s=Running("sum", v),
        lo=Running("min", v, inclusive=False),
        hi=Running("max", v),
        seen=Running("last", v, inclusive=False),
    )
    found = {
        (r["key"], r["ord"]): (r["n"], None if r["s"] is None else round(r["s"], 6), r["lo"], r["hi"], r["seen"])
        for r in got.collect()
    }
    assert found == expected(rows)
    assert set(got.columns) == {"key", "ord", "v", "n", "s", "lo", "hi", "seen"}


def test_slices_are_even_and_split_the_hot_key(spark):
    df = spark.range(10_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"), "id")
    sliced = slice_by_range(df, ["id"], ["key"], 20)
    hot = sliced.frame.filter("key = 'hot'").groupBy("_slice").count().collect()
    assert len(hot) >= 4 and max(r["count"] for r in hot) < 1500
    # What is broadcast is bounded by the slices, not by the keys.
    assert sliced.spanning().count() < 20
    plain = slice_by_range(df, ["id"], (), 20).frame.groupBy("_slice").count().collect()
    assert len(plain) >= 15 and max(r["count"] for r in plain) < 1500


@pytest.mark.parametrize("slices", [1, 10])
@pytest.mark.parametrize("partitions", [1, 17])
def test_row_index(spark, slices, partitions):
    start = datetime(2024, 3, 31, 1, 30)
    rows = [(i, start + timedelta(minutes=(i * 37) % 400)) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, at timestamp_ntz").repartition(partitions)
    got = {r["id"]: r["idx"] for r in row_index(df, ["at", "id"], slices=slices).collect()}
    ranked = sorted(rows, key=lambda r: (r[1], r[0]))
    assert got == {r[0]: i for i, r in enumerate(ranked)}


def test_doubles_and_text_survive_as_bounds(spark):
    rows = [(f"é{i % 7}\n{i}", (i * 0.1) ** 9) for i in range(300)]
    df = spark.createDataFrame(rows, "t string, d double")
    got = {r["t"]: r["idx"] for r in row_index(df, ["d", "t"], slices=20).collect()}
    assert got == {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}


def test_instants_around_the_clock_change(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # 2024-11-03 05:00 UTC: local time repeats an hour.
        df = spark.range(400).select("id", F.timestamp_seconds(1730606400 + (F.col("id") * 7 % 400) * 30).alias("at"))
        got = {r["id"]: r["idx"] for r in row_index(df, ["at", "id"], slices=15).collect()}
        assert got == {i: i * 7 % 400 for i in range(400)}
        per = running(slice_by_range(df, ["id"], ["at"]), n=Running("count"))
        assert per.filter("n <> 1").count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
