"""Graph tables."""

from pyspark.sql import functions as F

from molframe.catalog.base import GRAPH_SQL, UNIT_SQL, molecule_graphs, register, rounded
from molframe.operators.graph import (
    exact_negative_edges,
    mask_nodes,
    negative_edges,
    negatives_short,
    neighbor_agg,
    node_degree,
    nodes_by_degree,
    readout,
)
from molframe.operators.vocab import node_contexts, number_tokens

ARCS_SQL = f"""
{GRAPH_SQL},
arcs AS (SELECT mol, src AS a, dst AS b FROM bonds UNION ALL SELECT mol, dst, src FROM bonds)
"""


@register(
    "atoms_bonds",
    f"""
    WITH {GRAPH_SQL}
    SELECT 'atom' AS part, mol, pos AS x, pos AS y, symbol AS tag FROM atoms
    UNION ALL
    SELECT 'bond' AS part, mol, src AS x, dst AS y, kind AS tag FROM bonds
    """,
)
def tables(spark, sf_dir):
    atoms, bonds = molecule_graphs(spark, sf_dir)
    return atoms.select(
        F.lit("atom").alias("part"), "mol", F.col("pos").alias("x"), F.col("pos").alias("y"), F.col("symbol").alias("tag")
    ).unionByName(
        bonds.select(
            F.lit("bond").alias("part"), "mol", F.col("src").alias("x"), F.col("dst").alias("y"), F.col("kind").alias("tag")
        )
    )


@register("node_degree", f"WITH {ARCS_SQL} SELECT mol, a AS pos, count(*) AS degree FROM arcs GROUP BY 1, 2")
def degree(spark, sf_dir):
    return node_degree(molecule_graphs(spark, sf_dir)[1])


@register(
    "nodes_by_degree",
    f"""
    WITH {ARCS_SQL}, d AS (SELECT mol, a, count(*) AS degree FROM arcs GROUP BY 1, 2)
    SELECT mol, degree, count(*) AS n_atoms FROM d GROUP BY 1, 2
    """,
)
def by_degree(spark, sf_dir):
    return nodes_by_degree(molecule_graphs(spark, sf_dir)[1])


def _chosen(pos: str) -> str:
    return UNIT_SQL.format(f"'9|' || CAST(mol AS VARCHAR) || '|' || CAST({pos} AS VARCHAR)") + " < 0.1::DOUBLE"


@register(
    "mask_nodes",
    f"""
    WITH {GRAPH_SQL}
    SELECT 'atom' AS part, mol, pos AS x, pos AS y, {_chosen('pos')} AS masked FROM atoms
    UNION ALL
    SELECT 'bond' AS part, mol, src AS x, dst AS y, {_chosen('src')} OR {_chosen('dst')} AS masked FROM bonds
    """,
)
def masks(spark, sf_dir):
    atoms, bonds = mask_nodes(*molecule_graphs(spark, sf_dir), rate=0.1, seed=9)
    return atoms.select(F.lit("atom").alias("part"), "mol", F.col("pos").alias("x"), F.col("pos").alias("y"), "masked").unionByName(
        bonds.select(F.lit("bond").alias("part"), "mol", F.col("src").alias("x"), F.col("dst").alias("y"), "masked")
    )


_KEY = "'13|' || CAST(mol AS VARCHAR) || '|' || CAST(u AS VARCHAR) || '|' || CAST(v AS VARCHAR) || '|' || CAST(j AS VARCHAR)"


@register(
    "negative_edges",
    f"""
    WITH {GRAPH_SQL},
    real AS (SELECT mol, least(src, dst) AS u, greatest(src, dst) AS v FROM bonds),
    tries AS (SELECT mol, u, v, n, unnest([0, 1]) AS j FROM real JOIN sizes USING (mol)),
    ends AS (SELECT mol, ('0x' || substr(md5({_KEY}), 1, 8))::BIGINT % n AS x,
                    ('0x' || substr(md5({_KEY}), 9, 8))::BIGINT % n AS y FROM tries),
    proposed AS (SELECT DISTINCT mol, least(x, y) AS u, greatest(x, y) AS v FROM ends WHERE x <> y)
    SELECT mol, u, v, 1 AS label FROM real
    UNION ALL
    SELECT mol, u, v, 0 AS label FROM proposed ANTI JOIN real USING (mol, u, v)
    """,
)
def non_bonds(spark, sf_dir):
    return negative_edges(*molecule_graphs(spark, sf_dir), k=2, seed=13)


# Every pair of a molecule with its place in the keyed order; the first non-bonds are the sample.
PLACED_SQL = f"""
{GRAPH_SQL},
real AS (SELECT DISTINCT mol, least(src, dst) AS u, greatest(src, dst) AS v FROM bonds WHERE src <> dst),
wanted AS (SELECT mol, count(*) AS m FROM real GROUP BY 1),
keyed AS (SELECT mol, n, n * (n - 1) // 2 AS pairs,
                 ('0x' || substr(md5('13|' || CAST(mol AS VARCHAR) || '|shift'), 1, 15))::BIGINT % (n * (n - 1) // 2) AS shift,
                 ('0x' || substr(md5('13|' || CAST(mol AS VARCHAR) || '|turn'), 1, 15))::BIGINT % n AS turn FROM sizes WHERE n > 1),
ends AS (SELECT mol, n, pairs, shift, turn, unnest(range(n)) AS u FROM keyed),
every AS (SELECT mol, n, pairs, shift, u, unnest(range(u + 1, n)) AS v, turn FROM ends),
turned AS (SELECT mol, n, pairs, shift, u, v, least((u + turn) % n, (v + turn) % n) AS low, greatest((u + turn) % n, (v + turn) % n) AS high FROM every),
placed AS (SELECT mol, u, v, (CASE WHEN 2 * (high - low) <= n THEN (high - low - 1) * n + low ELSE (n - high + low - 1) * n + high END
                              * (2 * n - 1) + shift) % pairs AS place FROM turned),
ranked AS (SELECT mol, u, v, row_number() OVER (PARTITION BY mol ORDER BY place) AS r FROM placed ANTI JOIN real USING (mol, u, v)),
drawn AS (SELECT mol, u, v FROM ranked JOIN wanted USING (mol) WHERE r <= 2 * m)
"""


@register(
    "exact_negative_edges",
    f"WITH {PLACED_SQL} SELECT mol, u, v, 1 AS label FROM real UNION ALL SELECT mol, u, v, 0 AS label FROM drawn",
)
def exact_non_bonds(spark, sf_dir):
    return exact_negative_edges(*molecule_graphs(spark, sf_dir), k=2, seed=13)


@register(
    "negatives_short",
    f"""
    WITH {PLACED_SQL}, made AS (SELECT mol, count(*) AS c FROM drawn GROUP BY 1)
    SELECT mol, m AS n_bonds, coalesce(c, 0) AS n_negatives, 2 * m - coalesce(c, 0) AS short
    FROM wanted LEFT JOIN made USING (mol) WHERE 2 * m > coalesce(c, 0)
    """,
)
def too_dense(spark, sf_dir):
    return negatives_short(exact_negative_edges(*molecule_graphs(spark, sf_dir), k=2, seed=13), 2)


@register(
    "vocab_node_context",
    f"""
    WITH {ARCS_SQL},
    near AS (SELECT arcs.mol, arcs.a AS pos, symbol AS s, count(*) AS n
             FROM arcs JOIN atoms ON arcs.mol = atoms.mol AND arcs.b = atoms.pos GROUP BY 1, 2, 3),
    around AS (SELECT mol, pos, string_agg(s || n::VARCHAR, '-' ORDER BY s || n::VARCHAR) AS ctx FROM near GROUP BY 1, 2),
    tokens AS (SELECT symbol || '_' || coalesce(ctx, '') AS token FROM atoms LEFT JOIN around USING (mol, pos)),
    counted AS (SELECT token, count(*) AS n FROM tokens GROUP BY 1)
    SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS token_id FROM counted
    UNION ALL SELECT '<unk>', 0, 0
    """,
)
def contexts(spark, sf_dir):
    rows = node_contexts(*molecule_graphs(spark, sf_dir)).filter("kind = 'atom'")
    counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return number_tokens(counts, specials=("<unk>",))


@register(
    "vocab_bond_context",
    f"""
    WITH {GRAPH_SQL},
    tokens AS (SELECT least(s.symbol, d.symbol) || '_' || kind || '_' || greatest(s.symbol, d.symbol) AS token
               FROM bonds JOIN atoms s ON bonds.mol = s.mol AND src = s.pos JOIN atoms d ON bonds.mol = d.mol AND dst = d.pos),
    counted AS (SELECT token, count(*) AS n FROM tokens GROUP BY 1)
    SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS token_id FROM counted
    UNION ALL SELECT '<unk>', 0, 0
    """,
)
def bond_contexts(spark, sf_dir):
    rows = node_contexts(*molecule_graphs(spark, sf_dir)).filter("kind = 'bond'")
    counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return number_tokens(counts, specials=("<unk>",))


@register(
    "neighbor_agg",
    f"""
    WITH {ARCS_SQL}
    SELECT arcs.mol, a AS pos, round(avg(quantity), 6) AS mean_quantity, max(quantity) AS max_quantity, sum(quantity) AS sum_quantity
    FROM arcs JOIN atoms ON arcs.mol = atoms.mol AND arcs.b = atoms.pos GROUP BY 1, 2
    """,
)
def neighbours(spark, sf_dir):
    found = neighbor_agg(*molecule_graphs(spark, sf_dir), "quantity", ("mean", "max", "sum"))
    return found.withColumn("mean_quantity", rounded("mean_quantity"))


@register("graph_readout", f"WITH {GRAPH_SQL} SELECT mol, round(avg(quantity), 6) AS mean_quantity FROM atoms GROUP BY 1")
def pooled(spark, sf_dir):
    found = readout(molecule_graphs(spark, sf_dir)[0], "quantity")
    return found.withColumn("mean_quantity", rounded("mean_quantity"))
