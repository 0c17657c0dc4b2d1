"""Rings and linkers of molecule graphs, and a key that equal ones share.

Molecules of up to ``bound`` bonds are gathered one to a row and worked on by
whole Arrow batches, so that all of them take one shuffle. A larger molecule is
never gathered: its leaves and the paths behind them go by rake and compress,
and its atoms are told apart by joins, with the same arithmetic. How a molecule is
done depends on its own size alone and changes no result.

Bonds with a null end belong to no ring. Doubled bonds are a ring of two, and a
bond from an atom to itself is a ring of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.functions.hashing import hash32
from molframe.operators.joins import two_way
from molframe.plans.lineage import cut

#: Bonds, and atoms, of a molecule that is worked on inside one task.
BOUND = 20_000
#: Atoms of a core of which each is singled out in turn; larger cores are refined without.
ALONE = 256
#: Rounds of refinement: how many bonds around an atom its label tells of.
ROUNDS = 8
#: Labels held at once by a task.
LABELS = 1 << 20

#: Labels are two numbers below a prime for which x**5 is one to one; every product fits 64 bits.
PRIME = (1 << 31) - 1
SCALE, NEAR, STEP, SINGLE, END = (np.array(c) for c in ((48271, 69621), (11, 101), (12345, 54321), (777767, 424243), (31, 57)))

# Fixed value: the element of an atom written in brackets, after its isotope.
ELEMENT = r"^\[[0-9]*([A-Z][a-z]?|[a-z][a-z]?|\*).*\]$"


def element(symbol: Column) -> Column:
    """What an atom is, without isotope, hydrogens, charge and stereo marks."""
    return F.when(symbol.rlike(ELEMENT), F.regexp_extract(symbol, ELEMENT, 1)).otherwise(symbol)


def plain_kind(kind: Column, s1: Column, s2: Column) -> Column:
    """Kind of a bond without its direction; between two aromatic atoms ``-`` and ``:`` are one kind."""
    single = F.when(kind.isin("/", "\\"), "-").otherwise(kind)
    aromatic = s1.rlike("^[a-z]") & s2.rlike("^[a-z]")
    return F.when(aromatic & single.isin("-", ":"), ":").otherwise(single)


def _larger(rows: DataFrame, bound: int) -> DataFrame | None:
    """Molecules with more rows than that, written; None if there are none."""
    large = cut(rows.groupBy("mol").count().filter(F.col("count") > bound).select("mol"))
    return None if large.isEmpty() else large


def two_core(bonds: DataFrame, bound: int = BOUND) -> DataFrame:
    """Bonds left after repeatedly removing atoms with a single bond: rings and linkers."""
    bonds = cut(bonds.filter("src IS NOT NULL AND dst IS NOT NULL"))
    large = _larger(bonds, bound)
    if large is None:
        return _core_in_tasks(bonds)
    small = _core_in_tasks(bonds.join(large, "mol", "left_anti"))
    return small.unionByName(_core_by_rounds(bonds.join(large, "mol", "left_semi")))


def _core_in_tasks(bonds: DataFrame) -> DataFrame:
    others = [c for c in bonds.columns if c != "mol"]
    gathered = bonds.groupBy("mol").agg(F.collect_list(F.struct(*others)).alias("b"))
    stays = F.arrow_udf(_core_of_rows, "array<boolean>")
    marked = gathered.withColumn("stays", stays(F.col("b.src").cast("array<bigint>"), F.col("b.dst").cast("array<bigint>")))
    core = F.filter("b", lambda bond, i: F.get("stays", i))
    return marked.select("mol", F.inline(core)).select(*bonds.columns)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists, and the row of each."""
    lengths = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), lengths)


def _numbered(rows: np.ndarray, *atoms: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Atoms of all rows numbered through: (row of each number, the numbers of each argument)."""
    places, dense = np.unique(np.concatenate(atoms), return_inverse=True)
    keys = np.tile(rows, len(atoms)) * max(1, len(places)) + dense
    found, numbers = np.unique(keys, return_inverse=True)
    return found // max(1, len(places)), np.split(numbers, len(atoms))


def _core_of_rows(src: pa.Array, dst: pa.Array) -> pa.Array:
    (u, row), (v, _) = _flat(src), _flat(dst)
    owner, (a, b) = _numbered(row, u, v)
    offsets = src.offsets.to_numpy() - src.offsets[0].as_py()
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(peel(a, b, len(owner))))


def peel(u: np.ndarray, v: np.ndarray, count: int) -> np.ndarray:
    """Which of the edges ``u, v`` between ``count`` vertices are left without leaves.

    Every vertex keeps its degree and the exclusive or of its edges' numbers,
    which is the number of the only edge of a leaf. Each turn touches the new
    leaves alone, so all turns together touch every edge once.
    """
    edges = np.arange(len(u))
    degree, name = np.bincount(u, minlength=count) + np.bincount(v, minlength=count), np.zeros(count, np.int64)
    np.bitwise_xor.at(name, u, edges)
    np.bitwise_xor.at(name, v, edges)
    stays = np.ones(len(u), bool)
    leaves = np.flatnonzero(degree == 1)
    while len(leaves):
        gone = np.unique(name[leaves])
        stays[gone] = False
        ends = np.concatenate([u[gone], v[gone]])
        np.subtract.at(degree, ends, 1)
        np.bitwise_xor.at(name, ends, np.tile(gone, 2))
        leaves = np.unique(ends[degree[ends] == 1])
    return stays


def _core_by_rounds(bonds: DataFrame) -> DataFrame:
    """The two-core by rake and compress.

    An arc a -> b that meets an atom of two bonds goes on behind it. Doubling
    these pointers leads each arc to the end of its path in as many rounds as the
    path's length has binary digits; paths that end in a leaf go at once. What is
    left of the trees halves each time, at least. Each round writes one table.
    """
    left = cut(bonds)
    while True:
        arcs = two_way(left).distinct()
        degree = cut(two_way(left).groupBy("mol", "a").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("both")))
        if degree.filter("n = 1").isEmpty():
            return left
        met = degree.toDF("mol", "b", "n", "both")
        goes_on = F.col("n") == 2
        pointers = cut(
            arcs.join(met, ["mol", "b"]).select(
                "mol", "a", "b",
                F.when(goes_on, F.col("b")).otherwise(F.col("a")).alias("x"),
                F.when(goes_on, F.col("both") - F.col("a")).otherwise(F.col("b")).alias("y"),
                goes_on.alias("open"), (F.col("n") == 1).alias("leaf"),
            )
        )
        still = pointers.filter("open").count()
        while still:
            ahead = pointers.select("mol", F.col("a").alias("x"), F.col("b").alias("y"), F.struct("x", "y", "open", "leaf").alias("p"))
            jumped = pointers.filter("open").join(ahead, ["mol", "x", "y"]).select("mol", "a", "b", "p.*")
            pointers = cut(pointers.filter("not open").unionByName(jumped))
            before, still = still, pointers.filter("open").count()
            if still == before:
                break  # what is open now runs in a ring
        loose = pointers.filter("leaf").select("mol", F.least("a", "b").alias("_lo"), F.greatest("a", "b").alias("_hi")).distinct()
        ends = {"_lo": F.least("src", "dst").cast("bigint"), "_hi": F.greatest("src", "dst").cast("bigint")}
        left = cut(left.withColumns(ends).join(loose, ["mol", "_lo", "_hi"], "left_anti").select(*bonds.columns))


def scaffold_key(bonds: DataFrame, atoms: DataFrame, bound: int = BOUND, alone: int = ALONE) -> DataFrame:
    """``mol, group_key``: equal for molecules whose rings and linkers are the same graph; empty for acyclic ones.

    Atoms count by element and aromatic spelling, bonds by kind without
    direction (``element``, ``plain_kind``). Labels start from the element and
    take in those of their neighbours, with the bond's kind, ROUNDS times. In a
    core of up to ``alone`` atoms this is done once for every atom singled out by
    a mark of its own, which tells apart graphs that look alike around each atom,
    such as two fused rings and two linked ones. Sums over atoms, and over atoms
    singled out, forget the order of writing.
    """
    bonds = cut(bonds.filter("src IS NOT NULL AND dst IS NOT NULL").select("mol", F.col("src").cast("bigint"), F.col("dst").cast("bigint"), "kind"))
    atoms = cut(atoms.select("mol", F.col("pos").cast("bigint"), element(F.col("symbol")).alias("symbol")))
    large = _larger(bonds.select("mol").unionByName(atoms.select("mol")), bound)
    if large is None:
        keys = _keys_in_tasks(bonds, atoms, alone)
    else:
        keys = _keys_in_tasks(bonds.join(large, "mol", "left_anti"), atoms.join(large, "mol", "left_anti"), alone)
        core = cut(_core_by_rounds(bonds.join(large, "mol", "left_semi")))
        ends = two_way(core).select("mol", F.col("a").alias("pos")).distinct()
        within = cut(atoms.join(ends, ["mol", "pos"]))
        wide = cut(core.select("mol").unionByName(within.select("mol")).groupBy("mol").count().filter(F.col("count") > bound).select("mol"))
        keys = keys.unionByName(_keys_in_tasks(core.join(wide, "mol", "left_anti"), within.join(wide, "mol", "left_anti"), alone))
        keys = keys.unionByName(_keys_by_rounds(core.join(wide, "mol", "left_semi"), within.join(wide, "mol", "left_semi")))
    named = keys.filter("n_bonds > 0").select("mol", F.md5(F.concat_ws(":", "n_atoms", "n_bonds", "x", "y")).alias("group_key"))
    molecules = atoms.select("mol").distinct()
    return molecules.join(named, "mol", "left").select("mol", F.coalesce("group_key", F.lit("")).alias("group_key"))


def _lanes(value: Column) -> Column:
    """Two numbers below PRIME."""
    return F.array(*[hash32(value, w) % PRIME for w in (0, 1)])


KEY = "struct<n_atoms:bigint,n_bonds:bigint,x:bigint,y:bigint>"


def _keys_in_tasks(bonds: DataFrame, atoms: DataFrame, alone: int) -> DataFrame:
    single = F.when(F.col("kind").isin("/", "\\"), "-").otherwise(F.col("kind"))
    lanes, soft = _lanes(single), single.isin("-", ":")
    typed = bonds.select("mol", "src", "dst", *[lanes[i].alias(f"k{i}") for i in (0, 1)], soft.alias("soft"))
    marks = _lanes(F.col("symbol"))
    placed = atoms.select("mol", "pos", *[marks[i].alias(f"s{i}") for i in (0, 1)], F.col("symbol").rlike("^[a-z]").alias("aromatic"))
    gathered = typed.groupBy("mol").agg(F.collect_list(F.struct("src", "dst", "k0", "k1", "soft")).alias("b"))
    around = placed.groupBy("mol").agg(F.collect_list(F.struct("pos", "s0", "s1", "aromatic")).alias("a"))

    def keyed(src: pa.Array, dst: pa.Array, k0: pa.Array, k1: pa.Array, soft: pa.Array, pos: pa.Array, s0: pa.Array, s1: pa.Array, aromatic: pa.Array) -> pa.Array:
        found = _keys_of_rows(*map(_flat, (src, dst, k0, k1, soft, pos, s0, s1, aromatic)), count=len(src), alone=alone, arc=ARC)
        return pa.StructArray.from_arrays([pa.array(c) for c in found], ["n_atoms", "n_bonds", "x", "y"])

    # The kind that soft bonds between aromatic atoms are given.
    ARC = [int(v) for v in bonds.sparkSession.range(1).select(_lanes(F.lit(":")).alias("k")).first()["k"]]
    parts = [f"b.{c}" for c in ("src", "dst", "k0", "k1", "soft")] + [f"a.{c}" for c in ("pos", "s0", "s1", "aromatic")]
    key = F.arrow_udf(keyed, KEY)
    return gathered.join(around, "mol").select("mol", key(*map(F.col, parts)).alias("key")).select("mol", "key.*")


def _fifth(x: np.ndarray) -> np.ndarray:
    square = x * x % PRIME
    return square * square % PRIME * x % PRIME


def _gathered_sum(at: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    total = np.zeros((count, values.shape[1]), np.int64)
    np.add.at(total, at, values)
    return total % PRIME


def _keys_of_rows(src, dst, k0, k1, soft, pos, s0, s1, aromatic, count: int, alone: int, arc: list[int]) -> list[np.ndarray]:
    """KEY of each of ``count`` molecules; each argument is (values, rows)."""
    places, dense = np.unique(np.concatenate([src[0], dst[0], pos[0]]), return_inverse=True)
    keys = np.concatenate([src[1], dst[1], pos[1]]) * max(1, len(places)) + dense
    found, numbers = np.unique(keys, return_inverse=True)
    u, v, at = np.split(numbers, np.cumsum([len(src[0]), len(dst[0])]))
    stays = peel(u, v, len(found))
    u, v, row = u[stays], v[stays], src[1][stays]
    label, soft_end = np.zeros((len(found), 2), np.int64), np.zeros(len(found), bool)
    label[at] = np.column_stack([s0[0], s1[0]])
    soft_end[at] = aromatic[0].astype(bool)
    kind = np.column_stack([k0[0], k1[0]]).astype(np.int64)[stays]
    kind[soft[0].astype(bool)[stays] & soft_end[u] & soft_end[v]] = arc
    # Number the atoms of the cores alone, molecule by molecule.
    used, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = np.split(ends, 2)
    owner, label = found[used] // max(1, len(places)), label[used]
    order = np.argsort(row, kind="stable")
    u, v, kind, row = u[order], v[order], kind[order], row[order]
    n_atoms, n_bonds = np.bincount(owner, minlength=count), np.bincount(row, minlength=count)
    key = np.zeros((count, 2), np.int64)
    for rows, copies in _runs(n_atoms, alone):
        first, last = np.searchsorted(owner, [rows[0], rows[1]])
        start, stop = np.searchsorted(row, [rows[0], rows[1]])
        key[rows[0] : rows[1]] = _refined(
            u[start:stop] - first, v[start:stop] - first, kind[start:stop], row[start:stop] - rows[0],
            label[first:last], owner[first:last] - rows[0], copies, n_atoms[rows[0] : rows[1]] <= alone,
        )
    return [n_atoms, n_bonds, key[:, 0], key[:, 1]]


def _runs(n_atoms: np.ndarray, alone: int) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """Ranges of molecules whose labels fit LABELS together, with the copies of each that are refined."""
    copies = np.where(n_atoms <= alone, n_atoms, 1)
    labels = np.concatenate([[0], np.cumsum(copies * n_atoms)])
    start = 0
    while start < len(n_atoms):
        stop = max(start + 1, int(np.searchsorted(labels, labels[start] + LABELS, "right")) - 1)
        yield (start, stop), copies[start:stop]
        start = stop


def _refined(u, v, kind, row, label, owner, copies, singled) -> np.ndarray:
    """Two numbers a molecule. If a molecule is ``singled``, its copy c has its c-th atom marked."""
    n_atoms = np.bincount(owner, minlength=len(copies))
    n_bonds = np.bincount(row, minlength=len(copies))
    base = np.concatenate([[0], np.cumsum(copies * n_atoms)])[:-1]
    first = np.concatenate([[0], np.cumsum(n_atoms)])[:-1]
    # Atom i of a molecule's copy c is number base + c * n_atoms + i.
    mol = np.repeat(np.arange(len(copies)), copies * n_atoms)
    inside = np.arange(len(mol)) - base[mol]
    of_copy, atom = inside // np.maximum(1, n_atoms[mol]), inside % np.maximum(1, n_atoms[mol])
    now = label[first[mol] + atom]
    alone = singled[mol] & (of_copy == atom)
    now = np.where(alone[:, None], (now + SINGLE) % PRIME, now)
    bond_base = np.concatenate([[0], np.cumsum(n_bonds)])[:-1]
    of = np.repeat(np.arange(len(copies)), copies * n_bonds)
    step = np.arange(len(of)) - np.concatenate([[0], np.cumsum(copies * n_bonds)])[:-1][of]
    bond = bond_base[of] + step % np.maximum(1, n_bonds[of])
    shift = base[of] + step // np.maximum(1, n_bonds[of]) * n_atoms[of] - first[of]
    a, b, k = u[bond] + shift, v[bond] + shift, kind[bond]
    for _ in range(ROUNDS):
        near = _gathered_sum(np.concatenate([a, b]), np.concatenate([_fifth((now[b] + k + NEAR) % PRIME), _fifth((now[a] + k + NEAR) % PRIME)]), len(now))
        now = _fifth((now * SCALE % PRIME + near + STEP) % PRIME)
    copy_base = np.concatenate([[0], np.cumsum(copies)])[:-1]
    per_copy = _gathered_sum(copy_base[mol] + of_copy, _fifth(now), int(copies.sum()))
    return _gathered_sum(np.repeat(np.arange(len(copies)), copies), _fifth((per_copy + END) % PRIME), len(copies))


def _keys_by_rounds(core: DataFrame, atoms: DataFrame) -> DataFrame:
    """KEY of cores too large for one task: the same sums by joins, with no atom singled out."""

    def fifth(x: Column) -> Column:
        return ((x * x % PRIME) * (x * x % PRIME) % PRIME) * x % PRIME

    ends = [atoms.select("mol", F.col("pos").alias(e), F.col("symbol").alias(f"{e}_symbol")) for e in ("src", "dst")]
    typed = core.join(ends[0], ["mol", "src"]).join(ends[1], ["mol", "dst"])
    kind = _lanes(plain_kind(F.col("kind"), F.col("src_symbol"), F.col("dst_symbol")))
    both = [F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in (("src", "dst"), ("dst", "src"))]
    arcs = cut(typed.select("mol", kind.alias("k"), F.explode(F.array(*both)).alias("arc")).select("mol", "k", "arc.*"))
    labels = cut(atoms.select("mol", "pos", _lanes(F.col("symbol")).alias("now")))
    for _ in range(ROUNDS):
        near = arcs.join(labels.select("mol", F.col("pos").alias("b"), "now"), ["mol", "b"])
        sums = near.groupBy("mol", F.col("a").alias("pos")).agg(
            *[(F.sum(fifth((F.col("now")[i] + F.col("k")[i] + int(NEAR[i])) % PRIME)) % PRIME).alias(f"near{i}") for i in (0, 1)]
        )
        moved = [fifth((F.col("now")[i] * int(SCALE[i]) % PRIME + F.col(f"near{i}") + int(STEP[i])) % PRIME) for i in (0, 1)]
        labels = cut(labels.join(sums, ["mol", "pos"]).select("mol", "pos", F.array(*moved).alias("now")))
    total = [fifth((F.sum(fifth(F.col("now")[i])) % PRIME + int(END[i])) % PRIME).alias(c) for i, c in enumerate("xy")]
    digests = labels.groupBy("mol").agg(F.count(F.lit(1)).alias("n_atoms"), *total)
    return digests.join(core.groupBy("mol").agg(F.count(F.lit(1)).alias("n_bonds")), "mol").select("mol", "n_atoms", "n_bonds", "x", "y")
