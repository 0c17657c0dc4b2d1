"""Molecule graphs as tables: atoms ``(mol, pos, symbol)`` and bonds ``(mol, src, dst, kind)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molframe.functions.hashing import hash32, hash60, seeded, unit_hash
from molframe.functions.tokens import tokenize
from molframe.operators.joins import two_way
from molframe.plans.lineage import cut, partitions
from molframe.plans.ordered import Running, running, slice_by_range

# What each written token means.
ATOM = r"^(\[.*\]|Br|Cl|[BCNOSPFI]|[bcnops]|\*)$"
BOND = r"^[-=#:~/\\$]$"
RING = r"^(%[0-9]{2}|[0-9])$"
AROMATIC = r"^(\[[0-9]*([bcnops]|te|as).*\]|[bcnops])$"


def atoms_bonds(df: DataFrame, mol: str, sequence: str) -> tuple[DataFrame, DataFrame]:
    """Atoms and bonds of written molecules, by windows over their tokens.

    The compact strings are shuffled once by molecule; three windows then work
    inside one string, so their size is bounded by that string: one along the
    string, one along its lanes, which are the tokens of one branch depth, and one
    along the uses of each ring label. An atom bonds to the previous atom of its
    lane, an opening parenthesis bonds the last atom of its lane to the atom it
    opens with, and every second use of a ring label closes a ring between the
    last atoms of their lanes. ``mol`` must be unique.
    """
    here = Window.partitionBy("mol").orderBy("i")
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    lane = Window.partitionBy("mol", "fragment", "level").orderBy("i")
    label = Window.partitionBy("mol", "label").orderBy("i")

    def tokens_like(name, pattern):
        return F.coalesce(F.regexp_like(name, F.lit(pattern)), F.lit(False))

    tokens = (
        df.select(F.col(mol).alias("mol"), F.col(sequence).alias("seq"))
        .repartition("mol")
        .select("mol", F.posexplode(tokenize(F.col("seq"), "smiles")).alias("i", "tok"))
        .withColumns(
            {
                "is_atom": tokens_like("tok", ATOM),
                "is_ring": tokens_like("tok", RING),
                "opens": F.col("tok") == "(",
            }
        )
    )
    atoms_so_far = F.sum(F.col("is_atom").cast("int")).over(upto) - 1
    if_atom = F.when(F.col("is_atom"), F.struct("pos", tokens_like("tok", AROMATIC).alias("aromatic")))
    placed = tokens.withColumns(
        {
            "pos": atoms_so_far,
            "fragment": F.sum((F.col("tok") == ".").cast("int")).over(upto),
            "depth": F.sum(F.when(F.col("opens"), 1).when(F.col("tok") == ")", -1).otherwise(0)).over(upto),
            "prev": F.lag("tok").over(here),
            "prev2": F.lag("tok", 2).over(here),
            "next": F.lead("tok").over(here),
            "next2": F.lead("tok", 2).over(here),
        }
    )
    atoms = placed.filter("is_atom").select("mol", "pos", F.col("tok").alias("symbol"))

    laned = placed.withColumns(
        {
            "atom": if_atom,
            "after_bond": tokens_like("prev", BOND),
            "before_bond": tokens_like("next", BOND),
            "label": F.when(F.col("is_ring"), F.regexp_replace("tok", "%", "").cast("int")),
            # An opening parenthesis stays at the depth it opens from.
            "level": F.col("depth") - F.col("opens").cast("int"),
        }
    ).withColumns(
        {
            "opened": F.when(F.col("after_bond"), F.col("prev2")).otherwise(F.col("prev")) == "(",
            "opens_with": F.when(F.col("before_bond"), F.col("next2")).otherwise(F.col("next")),
            "written": F.when(F.col("after_bond"), F.col("prev")),
            "will_write": F.when(F.col("before_bond"), F.col("next")),
        }
    )
    linked = laned.withColumns(
        {
            "same": F.last("atom", ignorenulls=True).over(lane.rowsBetween(Window.unboundedPreceding, -1)),
        }
    ).withColumns({"nth": F.row_number().over(label), "twin": F.lag(F.struct("same", "written")).over(label)})

    def bond(src, dst, written, aromatic):
        mark = F.coalesce(written, F.when(aromatic, ":").otherwise("-"))
        return F.struct(src.alias("src"), dst.alias("dst"), mark.alias("kind"))

    same, twin = F.col("same"), F.col("twin")
    chain = bond(same["pos"], F.col("pos"), F.col("written"), same["aromatic"] & F.col("atom.aromatic"))
    branch = bond(same["pos"], F.col("pos") + 1, F.col("will_write"), same["aromatic"] & tokens_like("opens_with", AROMATIC))
    ring = bond(
        F.least(same["pos"], twin["same"]["pos"]), F.greatest(same["pos"], twin["same"]["pos"]),
        F.coalesce(twin["written"], F.col("written")), same["aromatic"] & twin["same"]["aromatic"],
    )
    hangs = same.isNotNull()
    found = (
        F.when(F.col("is_atom") & hangs & ~F.coalesce("opened", F.lit(False)), chain)
        .when(F.col("opens") & hangs & tokens_like("opens_with", ATOM), branch)
        .when(F.col("is_ring") & (F.col("nth") % 2 == 0), ring)
    )
    return atoms, linked.select("mol", found.alias("bond")).filter("bond is not null").select("mol", "bond.*")


def node_degree(bonds: DataFrame) -> DataFrame:
    """Number of bonds of each bonded atom."""
    return two_way(bonds).groupBy("mol", F.col("a").alias("pos")).agg(F.count(F.lit(1)).alias("degree"))


def nodes_by_degree(bonds: DataFrame) -> DataFrame:
    """Atoms of each degree per molecule."""
    return node_degree(bonds).groupBy("mol", "degree").agg(F.count(F.lit(1)).alias("n_atoms"))


def mask_nodes(
    atoms: DataFrame, bonds: DataFrame, rate: float = 0.1, seed: int = 0, edges: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Mark a hash-chosen share of atoms, and bonds touching one.

    The choice is a function of (molecule, atom), so bonds need no join.
    """
    def chosen(pos):
        return unit_hash(seeded(seed, F.col("mol"), F.col(pos))) < rate

    marked = bonds.withColumn("masked", (chosen("src") | chosen("dst")) if edges else F.lit(False))
    return atoms.withColumn("masked", chosen("pos")), marked


def negative_edges(atoms: DataFrame, bonds: DataFrame, k: int = 1, seed: int = 0) -> DataFrame:
    """Edge-prediction examples: bonds (label 1) and sampled non-bonds (label 0), at most ``k`` for each bond.

    ``exact_negative_edges`` finds exactly as many. Here each bond proposes ``k`` hashed atom pairs of its molecule; proposals that
    repeat, loop or are bonds go. Linear in the bonds whatever the molecule size.
    """
    real = cut(bonds.select("mol", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")))
    rows = real.count()
    sizes = atoms.groupBy("mol").agg((F.max("pos") + 1).alias("n_atoms"))
    # By molecule for their sizes, then by pair: the last two steps share one shuffle.
    by_mol, by_pair = partitions(real, rows), partitions(real, rows * k)
    sizes = sizes.repartition(by_mol, "mol")
    dealt = real.repartition(by_mol, "mol")
    tries = dealt.join(sizes, "mol").withColumn("j", F.explode(F.array(*[F.lit(j) for j in range(k)])))
    key = seeded(seed, F.col("mol"), F.col("u"), F.col("v"), F.col("j"))
    ends = tries.select("mol", (hash32(key, 0) % F.col("n_atoms")).alias("x"), (hash32(key, 1) % F.col("n_atoms")).alias("y"))
    proposed = (
        ends.filter("x <> y")
        .select("mol", F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
        .repartition(by_pair, "mol", "u", "v")
        .distinct()
        .join(real.repartition(by_pair, "mol", "u", "v"), ["mol", "u", "v"], "left_anti")
    )
    return real.withColumn("label", F.lit(1)).unionByName(proposed.withColumn("label", F.lit(0)))


def exact_negative_edges(
    atoms: DataFrame, bonds: DataFrame, k: int = 1, seed: int = 0, slices: int | None = None
) -> DataFrame:
    """Bonds (label 1) and exactly ``k`` different non-bonds for each (label 0), or all if there are fewer.

    The pairs of a molecule of n atoms are numbered by distance around the ring
    of all atoms, d, and start, u: (d - 1) * n + u. Multiplying by 2n - 1, whose
    square leaves 1 over a multiple of the number of pairs, and adding a keyed
    shift puts them in a keyed order that is its own inverse; atoms are turned by
    another keyed shift first. The non-bonds are the first of that order, with
    bonds skipped. Bonds are ranked by their own places in it, by the ordered scan;
    how many of them stand before the end tells where that is, and every bond then
    names k + 1 places, so a molecule of any size is dealt out bond by bond.

    Bonds count once, whatever their direction; those of an atom with itself, with
    a null end or with an atom that is not there take no part.
    """
    sizes = atoms.groupBy("mol").agg((F.max("pos") + 1).cast("bigint").alias("n"))
    # A molecule's keys are hashed once, not for each pair.
    sizes = _PairOrder(seed).keyed(sizes)
    pairs = bonds.select("mol", F.least("src", "dst").cast("bigint").alias("u"), F.greatest("src", "dst").cast("bigint").alias("v"))
    bare = cut(pairs.filter("u < v").distinct().join(sizes, "mol").filter("u >= 0 AND v < n"))
    real = bare.join(bare.groupBy("mol").agg(F.count(F.lit(1)).alias("m")), "mol")
    order = _PairOrder(seed)
    slices = slices or partitions(bare, bare.count())
    sliced = slice_by_range(real.withColumn("place", order.place("u", "v")), ["place"], ["mol"], slices, derived=True)
    ranked = cut(running(sliced, rank=Running("count")))
    before = F.count_if(F.col("place") - (F.col("rank") - 1) < k * F.col("m")).alias("before")
    ends = ranked.groupBy("mol").agg(before).select("mol", "before")
    first = (F.col("rank") - 1) * (k + 1)
    named = (
        ranked.join(ends, "mol")
        .withColumn("place", F.explode(F.sequence(first, first + k)))
        .filter((F.col("place") < order.pairs) & (F.col("place") < k * F.col("m") + F.col("before")))
    )
    drawn = named.select("mol", order.pair("place").alias("p")).select("mol", "p.u", "p.v").join(ranked, ["mol", "u", "v"], "left_anti")
    return ranked.select("mol", "u", "v", F.lit(1).alias("label")).unionByName(drawn.withColumn("label", F.lit(0)))


class _PairOrder:
    """Keyed order of the atom pairs of molecules with ``n`` atoms; columns ``n``, ``shift`` and ``turn`` must be there."""

    def __init__(self, seed: int):
        self.n = F.col("n")
        self.pairs = F.expr("n * (n - 1) div 2")
        self.seed = seed
        self.shift, self.turn = F.col("shift"), F.col("turn")

    def keyed(self, sizes: DataFrame) -> DataFrame:
        """Molecules with their shift and turn; of an atom without another there is no pair."""
        def key(name: str, of: Column) -> Column:
            return F.when(self.n > 1, hash60(seeded(self.seed, F.col("mol"), F.lit(name))) % of).alias(name)

        return sizes.select("mol", "n", key("shift", self.pairs), key("turn", self.n))

    def _stride(self, x: Column) -> Column:
        """(2n - 1) * x modulo the number of pairs; beyond 64 bits in decimals."""
        wide = "decimal(19,0)"
        product = (2 * self.n - 1).cast(wide) * x.cast(wide) % self.pairs.cast(wide)
        return F.when(self.n < 2_000_000, (2 * self.n - 1) * x % self.pairs).otherwise(product.cast("bigint"))

    def place(self, u: str, v: str) -> Column:
        n, a, b = self.n, (F.col(u) + self.turn) % self.n, (F.col(v) + self.turn) % self.n
        low, high = F.least(a, b), F.greatest(a, b)
        apart = high - low
        number = F.when(2 * apart <= n, (apart - 1) * n + low).otherwise((n - apart - 1) * n + high)
        return (self._stride(number) + self.shift) % self.pairs

    def pair(self, place: str) -> Column:
        n = self.n
        number = self._stride(F.pmod(F.col(place) - self.shift, self.pairs))
        start = number % n
        end = (start + (number - start) / n + 1).cast("bigint") % n
        a, b = F.pmod(start - self.turn, n), F.pmod(end - self.turn, n)
        return F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))


def negatives_short(edges: DataFrame, k: int) -> DataFrame:
    """Molecules of ``exact_negative_edges`` too dense for ``k`` non-bonds a bond: ``mol, n_bonds, n_negatives, short``."""
    counts = edges.groupBy("mol").agg(F.count_if(F.col("label") == 1).alias("n_bonds"), F.count_if(F.col("label") == 0).alias("n_negatives"))
    short = k * F.col("n_bonds") - F.col("n_negatives")
    return counts.withColumn("short", short).filter("short > 0")


HOW = {"mean": F.avg, "max": F.max, "sum": F.sum}


def neighbor_agg(atoms: DataFrame, bonds: DataFrame, value: str, how: str | tuple[str, ...] = "mean") -> DataFrame:
    """Aggregate ``value`` over the neighbours of each bonded atom."""
    names = (how,) if isinstance(how, str) else how
    values = atoms.select("mol", F.col("pos").alias("b"), F.col(value).alias("_v"))
    arcs = two_way(bonds).join(values, ["mol", "b"])
    return arcs.groupBy("mol", F.col("a").alias("pos")).agg(*[HOW[h]("_v").alias(f"{h}_{value}") for h in names])


def readout(atoms: DataFrame, value: str, how: str | tuple[str, ...] = "mean") -> DataFrame:
    """Pool a value over the atoms of each molecule."""
    names = (how,) if isinstance(how, str) else how
    return atoms.groupBy("mol").agg(*[HOW[h](value).alias(f"{h}_{value}") for h in names])
