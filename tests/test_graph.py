import random

from pyspark.sql import functions as F

from molframe.operators.graph import (
    atoms_bonds,
    exact_negative_edges,
    mask_nodes,
    negative_edges,
    negatives_short,
    neighbor_agg,
    node_degree,
    nodes_by_degree,
    readout,
)
from molframe.operators.joins import pairs_within_2
from molframe.operators.vocab import node_context_vocab
from tests.molecules import BOND_COUNTS, SEQUENCES, read_molecule


def grow(rng, depth=0):
    """A random molecule text with branches and fragments."""
    out = rng.choice(["C", "N", "O", "Cl", "[NH4+]", "c"])
    for _ in range(rng.randint(0, 4)):
        out += rng.choice(["", "", "=", "#"])
        if depth < 3 and rng.random() < 0.4:
            out += "C(" + grow(rng, depth + 1) + ")" + ("(" + rng.choice(["", "="]) + grow(rng, depth + 2) + ")" if rng.random() < 0.3 else "")
        out += rng.choice(["C", "N", "Br", "o"])
    return out


def test_atoms_and_bonds_equal_a_stack_reading(spark):
    rng = random.Random(4)
    rows = SEQUENCES + [(100 + i, grow(rng) + ("." + grow(rng) if i % 5 == 0 else "")) for i in range(60)]
    rows += [(500, "C1CC2C1CC2C1CC1"), (501, "N1CC(C2CC2)C1=O"), (502, "C")]
    rows += [(503, "C(C)1CCC1"), (504, "C1CC(C(C)(O)2)CC2C1"), (505, "CC(C(C)C)(N)1CC(C)(Cl)C1")]
    atoms, bonds = atoms_bonds(spark.createDataFrame(rows, "id int, smi string"), "id", "smi")
    found_atoms, found_bonds = {}, {}
    for r in atoms.collect():
        found_atoms.setdefault(r["mol"], {})[r["pos"]] = r["symbol"]
    for r in bonds.collect():
        found_bonds.setdefault(r["mol"], []).append((min(r["src"], r["dst"]), max(r["src"], r["dst"])))
    for mol, smi in rows:
        symbols, expected = read_molecule(smi)
        assert [found_atoms[mol][i] for i in range(len(symbols))] == symbols, smi
        assert sorted(found_bonds.get(mol, [])) == sorted(expected), smi
    assert {m: len(found_bonds[m]) for m in BOND_COUNTS} == BOND_COUNTS


def test_bond_kinds(spark):
    df = spark.createDataFrame([(1, "CC(=O)Oc1ccccc1"), (2, "C=1CC=1")], "id int, smi string")
    _, bonds = atoms_bonds(df, "id", "smi")
    kinds = {(r["mol"], r["src"], r["dst"]): r["kind"] for r in bonds.collect()}
    assert kinds[(1, 0, 1)] == "-" and kinds[(1, 1, 2)] == "=" and kinds[(1, 4, 5)] == ":" and kinds[(1, 3, 4)] == "-"
    assert kinds[(1, 4, 9)] == ":" and kinds[(2, 0, 2)] == "="


def chain(spark, n, mol=1):
    atoms = spark.createDataFrame([(mol, i, "C" if i % 2 else "N", float(i)) for i in range(n)], "mol int, pos bigint, symbol string, v double")
    bonds = spark.createDataFrame([(mol, i, i + 1, "-") for i in range(n - 1)], "mol int, src bigint, dst bigint, kind string")
    return atoms, bonds


def test_degree_pairs_and_pooling(spark):
    atoms, bonds = chain(spark, 5)
    degree = {r["pos"]: r["degree"] for r in node_degree(bonds).collect()}
    assert degree == {0: 1, 1: 2, 2: 2, 3: 2, 4: 1}
    assert {(r["degree"], r["n_atoms"]) for r in nodes_by_degree(bonds).collect()} == {(1, 2), (2, 3)}
    pairs = {(r["u"], r["v"]): r["distance"] for r in pairs_within_2(bonds).collect()}
    assert pairs == {(i, j): j - i for i in range(5) for j in range(i + 1, 5) if j - i <= 2}
    means = {r["pos"]: r["mean_v"] for r in neighbor_agg(atoms, bonds, "v").collect()}
    assert means == {0: 1.0, 1: 1.0, 2: 2.0, 3: 3.0, 4: 3.0}
    assert readout(atoms, "v", ("mean", "sum")).first()[1:] == (2.0, 10.0)


def test_pairs_in_a_triangle_take_the_short_way(spark):
    bonds = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 0, 2)], "mol int, src bigint, dst bigint")
    assert {r["distance"] for r in pairs_within_2(bonds).collect()} == {1}


def test_masking_covers_bonds_of_masked_atoms(spark):
    atoms, bonds = chain(spark, 400)
    a, b = mask_nodes(atoms, bonds, rate=0.1, seed=1)
    hit = {r["pos"] for r in a.filter("masked").collect()}
    assert 15 < len(hit) < 75
    assert all(r["masked"] == (r["src"] in hit or r["dst"] in hit) for r in b.collect())
    assert mask_nodes(atoms, bonds, edges=False)[1].filter("masked").count() == 0


def test_negative_edges_are_no_bonds(spark):
    atoms, bonds = chain(spark, 50)
    rows = negative_edges(atoms, bonds, k=2, seed=3).collect()
    real = {(i, i + 1) for i in range(49)}
    assert {(r["u"], r["v"]) for r in rows if r["label"] == 1} == real
    false = [(r["u"], r["v"]) for r in rows if r["label"] == 0]
    assert len(false) > 60 and len(set(false)) == len(false) and not set(false) & real
    assert all(0 <= u < v < 50 for u, v in false)


def test_context_vocabulary_of_a_hub(spark):
    atoms = spark.createDataFrame([(1, i, "O" if i else "Fe") for i in range(301)], "mol int, pos bigint, symbol string")
    bonds = spark.createDataFrame([(1, 0, i, "-") for i in range(1, 301)], "mol int, src bigint, dst bigint, kind string")
    of_atoms, of_bonds = node_context_vocab(atoms, bonds, specials=("<unk>",))
    assert [(r["token"], r["n"], r["token_id"]) for r in of_atoms.orderBy("token_id").collect()] == [
        ("<unk>", 0, 0), ("O_Fe1", 300, 1), ("Fe_O300", 1, 2),
    ]
    assert of_bonds.filter(F.col("token") == "Fe_-_O").first()["n"] == 300


def test_exactly_as_many_negatives(spark):
    """Random molecules, a complete one, a large sparse one, one whose atoms number more than products in 64 bits allow."""
    rng = random.Random(6)
    sizes, pairs = {}, {}
    for mol in range(40):
        sizes[mol] = rng.randint(2, 12)
        pairs[mol] = {tuple(sorted(rng.sample(range(sizes[mol]), 2))) for _ in range(rng.randint(1, 14))}
    sizes[50], pairs[50] = 6, {(i, j) for i in range(6) for j in range(i + 1, 6)}
    sizes[51], pairs[51] = 400, {(i, i + 1) for i in range(399)}
    sizes[52], pairs[52] = 3_000_000, {(i, 2_999_999 - i) for i in range(50)}
    atoms = spark.createDataFrame([(m, n - 1, "C") for m, n in sizes.items()], "mol int, pos bigint, symbol string")
    rows = [(m, v, u, "-") if u % 2 else (m, u, v, "-") for m, p in pairs.items() for u, v in p]
    odd = [(0, 0, 0, "-"), (0, 0, None, "-"), (0, 0, 99, "-"), *rows[:5], (77, 0, 1, "-")]
    bonds = spark.createDataFrame(rows + odd, "mol int, src bigint, dst bigint, kind string")
    for k in (1, 3):
        edges = exact_negative_edges(atoms, bonds, k, seed=5)
        got = {}
        for r in edges.collect():
            got.setdefault((r["mol"], r["label"]), []).append((r["u"], r["v"]))
        short = {r["mol"]: r["short"] for r in negatives_short(edges, k).collect()}
        for mol, n in sizes.items():
            real, drawn = got[mol, 1], got.get((mol, 0), [])
            assert sorted(real) == sorted(pairs[mol]) and not set(real) & set(drawn)
            assert all(0 <= u < v < n for u, v in drawn) and len(set(drawn)) == len(drawn)
            assert len(drawn) == min(k * len(real), n * (n - 1) // 2 - len(real))
            assert short.get(mol, 0) == k * len(real) - len(drawn)
        other = {(r["mol"], r["u"], r["v"]) for r in exact_negative_edges(atoms, bonds, k, seed=6).filter("label = 0 and mol = 51").collect()}
        assert other != {(51, *p) for p in got[51, 0]}


def test_a_hub_is_spread_over_cells(spark):
    """A hub of 3,000 bonds in cells of 100: no (middle node, cell) meets more than a few hundred bonds."""
    star = [(1, 0, i, "-") for i in range(1, 3001)] + [(2, 0, 1, "-"), (2, 1, 2, "-"), (2, 2, 0, "-"), (2, 1, 2, "=")]
    bonds = spark.createDataFrame(star, "mol int, src bigint, dst bigint, kind string")
    found = pairs_within_2(bonds, grid=100)
    counted = {(r["mol"], r["distance"]): r["count"] for r in found.groupBy("mol", "distance").count().collect()}
    assert counted == {(1, 1): 3000, (1, 2): 3000 * 2999 // 2, (2, 1): 3}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(mol" in plan and "mid" in plan and ", i#" in plan


def test_shuffles_of_pairs_grow_with_the_rows(spark, monkeypatch):
    """A task holds so many rows of a pair step whatever the input; more partitions change no row."""
    from molframe.operators import graph, joins
    from molframe.plans import lineage

    atoms = spark.range(400).selectExpr("id div 8 AS mol", "id % 8 AS pos")
    bonds = atoms.filter("pos > 0").selectExpr("mol", "pos - 1 AS src", "pos AS dst")
    made = {}
    for most in (1 << 20, 20):
        monkeypatch.setattr(graph, "partitions", lambda df, rows: lineage.partitions(df, rows, most))
        monkeypatch.setattr(joins, "partitions", lambda df, rows: lineage.partitions(df, rows, most))
        frames = [graph.negative_edges(atoms, bonds, 2), joins.pairs_within_2(bonds), graph.exact_negative_edges(atoms, bonds, 2)]
        plans = [f._jdf.queryExecution().executedPlan().toString() for f in frames[:2]]
        made[most] = (plans, [sorted(map(tuple, f.collect())) for f in frames])
    # 350 bonds: two tries each, and two arcs with two pairs each.
    assert "u#" in made[20][0][0] and ", 35)" in made[20][0][0] and ", 70)" in made[20][0][1]
    assert ", 35)" not in made[1 << 20][0][0] and made[20][1] == made[1 << 20][1]


def test_keys_of_a_molecule_are_hashed_once(spark):
    """The keyed order reads shift and turn as columns; it hashes nothing pair by pair."""
    from molframe.operators.graph import _PairOrder

    order = _PairOrder(3)
    pairs = spark.createDataFrame([(1, 5, 0, 3)], "mol bigint, n bigint, u bigint, v bigint")
    keyed = pairs.join(order.keyed(pairs.select("mol", "n")), ["mol", "n"])
    placed = keyed.withColumn("place", order.place("u", "v"))
    assert placed.select(order.pair("place").alias("p")).first()["p"] == (0, 3)
    assert "md5" not in str(order.place("u", "v")) and "md5" not in str(order.pair("place"))
