"""Rings, linkers and their keys: both paths, against peeling and canonical forms by hand."""

import random
from itertools import combinations, permutations

import numpy as np
import pytest

from molframe.operators import scaffold
from molframe.operators.graph import atoms_bonds
from molframe.operators.scaffold import peel, scaffold_key, two_core

BONDS = "mol int, src bigint, dst bigint, kind string"
ATOMS = "mol int, pos bigint, symbol string"


def peeled(edges):
    """Edges left, one leaf at a time."""
    left = list(edges)
    while True:
        ends = [x for e in left for x in e]
        loose = next((e for e in left if min(ends.count(e[0]), ends.count(e[1])) == 1), None)
        if loose is None:
            return sorted(left)
        left.remove(loose)


def random_graphs(n, seed=1):
    rng = random.Random(seed)
    out = {}
    for mol in range(n):
        size = rng.randint(2, 14)
        edges = [(rng.randrange(i), i) for i in range(1, size)]
        edges += [tuple(sorted(rng.sample(range(size), 2))) for _ in range(rng.randint(0, 3))]
        out[mol] = edges
    return out


def test_peeling_by_numbers():
    for edges in random_graphs(200).values():
        u, v = (np.array(x) for x in zip(*edges))
        kept = peel(u, v, int(max(u.max(), v.max())) + 1)
        assert sorted(e for e, k in zip(edges, kept) if k) == peeled(edges)


@pytest.mark.parametrize("bound", [0, 7, scaffold.BOUND])
def test_two_core_by_both_paths(spark, bound):
    graphs = random_graphs(60)
    rows = [(m, *e, "-") for m, edges in graphs.items() for e in edges] + [(900, 1, None, "-"), (901, 5, 5, "-"), (902, 1, 2, "-"), (902, 1, 2, "=")]
    got = {}
    for r in two_core(spark.createDataFrame(rows, BONDS), bound).collect():
        got.setdefault(r["mol"], []).append((r["src"], r["dst"]))
    expected = {m: peeled(e) for m, e in graphs.items() if peeled(e)} | {901: [(5, 5)], 902: [(1, 2), (1, 2)]}
    assert {m: sorted(e) for m, e in got.items()} == expected


def test_long_tails_take_few_rounds(spark, monkeypatch):
    """A tail of 1,000 atoms, one of 700 with a fork, and a ring of 300 that no pointer leaves."""
    tail = [(1, i, i + 1, "-") for i in range(1000)] + [(1, 0, 2000, "-"), (1, 0, 2001, "-"), (1, 2000, 2001, "-")]
    fork = [(2, i, i + 1, "-") for i in range(700)] + [(2, 350, 5000, "-")] + [(2, 5000 + i, 5001 + i, "-") for i in range(90)]
    ring = [(3, i, (i + 1) % 300, "-") for i in range(300)]
    written = []
    plain = scaffold.cut
    monkeypatch.setattr(scaffold, "cut", lambda df: written.append(1) or plain(df))
    kept = {r["mol"]: r["count"] for r in two_core(spark.createDataFrame(tail + fork + ring, BONDS), bound=0).groupBy("mol").count().collect()}
    assert kept == {1: 3, 3: 300}
    pointer_rounds = len(written) - 2 - 1 - 3 * 2  # bonds, larger ones, the copy; degrees, pointers and the rest of each turn
    assert pointer_rounds <= 12


def keys_of(spark, written, **how):
    atoms, bonds = atoms_bonds(spark.createDataFrame(list(enumerate(written)), "id int, smi string"), "id", "smi")
    return [r["group_key"] for r in sorted(scaffold_key(bonds, atoms, **how).collect(), key=lambda r: r["mol"])]


SAME = [
    ("NC1CCCC1C2CC2", "N[C@@H]1CCC[C@H]1C2CC2"), ("c1ccccc1-c1ccccc1", "c1ccccc1c1ccccc1"), ("C1CC1/C=C/C1CC1", "C1CC1C=CC1CC1"),
    ("c1cc[nH]c1", "c1ccn(C)c1"), ("[13CH2]1C[NH2+]C1", "C1CNC1"), ("c1cncnc1", "n1cccnc1"), ("C1CCC2CCCCC2C1", "C1CCCC2C1CCCC2"),
    ("C(C)1CCC1", "C1CCC1C"),
]
DIFFERENT = ["c1cncnc1", "c1cnccn1", "c1ccnnc1", "C1CCC2CCCCC2C1", "C1CCC(C1)C1CCCC1", "C1CC1CC1CC1", "C1CC1CCC1CC1", "C1CC=CC1", "CCO", "C1CCC1"]


def test_one_scaffold_has_one_key_and_others_another(spark):
    keys = keys_of(spark, [text for pair in SAME for text in pair] + DIFFERENT)
    pairs, others = keys[: 2 * len(SAME)], keys[2 * len(SAME) :]
    assert pairs[::2] == pairs[1::2]
    assert len(set(others)) == len(others) and others[DIFFERENT.index("CCO")] == ""


def test_paths_agree_on_keys(spark):
    written = [first for first, _ in SAME] + DIFFERENT
    assert keys_of(spark, written, bound=0, alone=0) == keys_of(spark, written, alone=0)
    # A small core of a large molecule is keyed like any other.
    assert keys_of(spark, ["C" * 60 + text for text in written], bound=60) == keys_of(spark, written)


def canonical(n, edges):
    return min(tuple(sorted(tuple(sorted((p[a], p[b]))) for a, b in edges)) for p in permutations(range(n)))


def test_every_graph_of_five_atoms(spark):
    """All graphs on five atoms: keys agree exactly where the cores are the same graph."""
    pairs = list(combinations(range(5), 2))
    graphs = [[e for i, e in enumerate(pairs) if bits >> i & 1] for bits in range(1 << len(pairs))]
    bonds = spark.createDataFrame([(m, *e, "-") for m, edges in enumerate(graphs) for e in edges], BONDS)
    atoms = spark.createDataFrame([(m, i, "C") for m in range(len(graphs)) for i in range(5)], ATOMS)
    keys = {r["mol"]: r["group_key"] for r in scaffold_key(bonds, atoms).collect()}
    shapes = {}
    for m, edges in enumerate(graphs):
        core = peeled(edges) if edges else []
        shapes.setdefault(canonical(5, core) if core else (), set()).add(keys[m])
    assert all(len(k) == 1 for k in shapes.values())
    assert len(set.union(*shapes.values())) == len(shapes) and shapes[()] == {""}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], BONDS)
    assert two_core(empty).count() == 0
    assert scaffold_key(empty, spark.createDataFrame([], ATOMS)).count() == 0
    assert [r["group_key"] for r in scaffold_key(empty, spark.createDataFrame([(1, 0, "C")], ATOMS)).collect()] == [""]
