import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from molframe.operators.split import (
    audit_split,
    contiguous_parts,
    fill_turns,
    graph_key,
    group_assignment,
    group_split,
    hash_split,
    minibatches,
    no_split,
    two_core,
    worker_shard,
)
from molframe.operators.graph import atoms_bonds
from tests.molecules import SEQUENCES


def greedy(sizes):
    """Group by group: {key: split}."""
    total = sum(sizes.values())
    train_cap, valid_cap = total * 8 // 10, total * 9 // 10
    train = valid = 0
    out = {}
    for key, n in sorted(sizes.items(), key=lambda kv: (-kv[1], kv[0])):
        if train + n <= train_cap:
            out[key], train = "train", train + n
        elif train + valid + n <= valid_cap:
            out[key], valid = "valid", valid + n
        else:
            out[key] = "test"
    return out


def as_rows(sizes):
    return [(k, i) for k, n in sizes.items() for i in range(n)]


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 5, "b": 5, "c": 3, "d": 2, "e": 2, "f": 1, "g": 1, "h": 1},
        {"hot": 40, **{f"k{i:03d}": 1 for i in range(80)}},
        {f"k{i:03d}": 1 + i % 4 for i in range(120)},
    ],
)
@pytest.mark.parametrize("slices", [1, 10])
def test_group_split_equals_greedy_walk(spark, sizes, slices):
    df = spark.createDataFrame(as_rows(sizes), "key string, i int").repartition(5)
    got = group_split(df, "key", slices=slices).select("key", "split").distinct().collect()
    assert {r["key"]: r["split"] for r in got} == greedy(sizes)


def test_group_split_fixture_and_null_key(spark):
    sizes = {"a": 5, "b": 5, "c": 3, "d": 2, "e": 2, "f": 1, "g": 1, "h": 1}
    want = greedy(sizes)
    assert [want[k] for k in "abcdefgh"] == ["train"] * 4 + ["valid", "train", "test", "test"]
    df = spark.createDataFrame([(None, 1), (None, 2), ("x", 3)], "key string, i int")
    out = group_split(df, "key").collect()
    assert len(out) == 3 and all(r["split"] for r in out)


def test_fill_agrees_with_walk_in_random_trials(spark):
    rng = random.Random(5)
    choices = [[1, 1, 1, 2, 3, 5, 8, 30], [1, 7, 64, 65, 130, 1000], [3, 4], list(range(1, 60))]
    for trial in range(4):
        sizes = {f"{i:04d}": rng.choice(choices[trial]) for i in range(rng.randint(1, 90))}
        groups = spark.createDataFrame(list(sizes.items()), "key string, n bigint")
        got = group_assignment(groups, "key", slices=3)
        assert {r["key"]: r["split"] for r in got.collect()} == greedy(sizes)
        # The same turning points wherever the driver takes over.
        every = [fill_turns(groups, (8, 1, 1), 3, small) for small in (0, 6, 1024)]
        assert every[0] == every[1] == every[2]


def test_fill_keeps_no_table_of_sizes(spark):
    """The turning points are few although every group has a size of its own, and no size is joined back."""
    groups = spark.range(1, 3001).select(F.col("id").cast("string").alias("key"), F.col("id").alias("n"))
    assert len(fill_turns(groups, (8, 1, 1))) < 40
    got = group_assignment(groups, "key")
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().toString()
    want = greedy({f"{n:04d}": n for n in range(1, 3001)})
    assert {r["n"]: r["split"] for r in got.collect()} == {int(k): v for k, v in want.items()}


def test_fill_of_no_groups(spark):
    assert group_assignment(spark.createDataFrame([], "key string, n bigint"), "key").collect() == []


def test_hash_split_is_stable_and_near_80_10_10(spark):
    df = spark.range(20_000)
    one = {r["id"]: r["split"] for r in hash_split(df.repartition(1), "id", 3).collect()}
    many = {r["id"]: r["split"] for r in hash_split(df.repartition(17), "id", 3).collect()}
    assert one == many
    share = Counter(one.values())
    assert abs(share["train"] / 20_000 - 0.8) < 0.02 and abs(share["valid"] / 20_000 - 0.1) < 0.02
    assert {r["split"] for r in no_split(df).collect()} == {"train"}


def test_parts_lose_no_row(spark):
    df = spark.range(10)
    parts = contiguous_parts(df, ["id"], 4)
    assert [r["count"] for r in parts.groupBy("part").count().orderBy("part").collect()] == [3, 2, 3, 2]
    sliced = contiguous_parts(spark.range(1000), ["id"], 7, slices=40)
    assert {r["id"]: r["part"] for r in sliced.collect()} == {i: i * 7 // 1000 for i in range(1000)}


def test_batches_and_workers(spark):
    got = minibatches(spark.range(10), ["id"], 4, slices=3).orderBy("id").collect()
    assert [(r["batch_id"], r["in_batch"]) for r in got] == [(i // 4, i % 4) for i in range(10)]
    got = worker_shard(spark.range(10), ["id"], 3).orderBy("id").collect()
    assert [r["worker"] for r in got] == [i % 3 for i in range(10)]


def test_audit_finds_leaks(spark):
    df = spark.createDataFrame(
        [(1, "a", "train"), (1, "a", "test"), (2, "b", "valid"), (3, "b", None)], "id int, key string, split string"
    )
    row = audit_split(df, "id", "key").first()
    assert (row["n_rows"], row["n_unassigned"], row["ids_in_many"], row["groups_in_many"]) == (4, 1, 1, 1)


def test_two_core_edge_counts(spark):
    df = spark.createDataFrame(SEQUENCES, "id int, smi string")
    atoms, bonds = atoms_bonds(df, "id", "smi")
    left = {r["mol"]: r["count"] for r in two_core(bonds).groupBy("mol").count().collect()}
    assert left == {1: 6, 3: 6, 4: 11, 5: 9}
    keys = {r["mol"]: r["group_key"] for r in graph_key(bonds, atoms).collect()}
    assert keys[2] == keys[6] == "" and len(set(keys.values())) == 5


def test_two_core_of_a_large_molecule(spark):
    """One molecule holding nearly all bonds: a ring with a long tail and a star."""
    ring = [(0, i, (i + 1) % 200, "-") for i in range(200)]
    tail = [(0, 200 + i - 1 if i else 0, 200 + i, "-") for i in range(9)]
    star = [(0, 0, 1000 + i, "-") for i in range(500)]
    df = spark.createDataFrame(ring + tail + star, "mol int, src bigint, dst bigint, kind string")
    assert two_core(df).count() == 200


def test_group_key_ignores_order(spark):
    a = spark.createDataFrame([(1, 0, "C"), (1, 1, "N"), (1, 2, "C"), (2, 0, "C"), (2, 1, "C"), (2, 2, "N")], "mol int, pos bigint, symbol string")
    b = spark.createDataFrame(
        [(1, 0, 1, "-"), (1, 1, 2, "="), (1, 0, 2, "-"), (2, 2, 1, "="), (2, 0, 1, "-"), (2, 0, 2, "-")],
        "mol int, src bigint, dst bigint, kind string",
    )
    keys = {r["mol"]: r["group_key"] for r in graph_key(b, a).collect()}
    assert keys[1] == keys[2] != ""


def test_one_scaffold_written_in_two_ways_has_one_key(spark):
    pairs = [
        ("NC1CCCC1C2CC2", "N[C@@H]1CCC[C@H]1C2CC2"),
        ("c1ccccc1-c1ccccc1", "c1ccccc1c1ccccc1"),
        ("C1CC1/C=C/C1CC1", "C1CC1C=CC1CC1"),
        ("c1cc[nH]c1", "c1ccn(C)c1"),
        ("[13CH2]1C[NH2+]C1", "C1CNC1"),
    ]
    written = [text for pair in pairs for text in pair]
    atoms, bonds = atoms_bonds(spark.createDataFrame(list(enumerate(written)), "id int, smi string"), "id", "smi")
    keys = {r["mol"]: r["group_key"] for r in graph_key(bonds, atoms).collect()}
    assert all(keys[2 * i] == keys[2 * i + 1] for i in range(len(pairs)))
    assert len(set(keys.values())) == len(pairs)
