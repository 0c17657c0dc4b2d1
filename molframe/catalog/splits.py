"""Splits, partitions and row numbers."""

from pyspark.sql import functions as F

from molframe.catalog.base import GRAPH_SQL, GROUP_KEY, group_key, molecule_graphs, register, split_sql, table
from molframe.operators.graph import atoms_bonds
from molframe.operators.scaffold import scaffold_key
from molframe.operators.split import (
    audit_split,
    contiguous_parts,
    graph_key,
    group_split,
    hash_split,
    minibatches,
    two_core,
    worker_shard,
)
from molframe.plans.ordered import row_index

# The greedy fill, group by group.
FILL_SQL = f"""
keyed AS (SELECT doc_id, {GROUP_KEY} AS key FROM documents),
groups AS (
  SELECT key, n, row_number() OVER (ORDER BY n DESC, key) AS r
  FROM (SELECT key, count(*) AS n FROM keyed GROUP BY 1)),
caps AS (SELECT count(*) * 8 // 10 AS tc, count(*) * 9 // 10 AS vc FROM keyed),
walk AS (
  SELECT 0::BIGINT AS r, ''::VARCHAR AS key, ''::VARCHAR AS split, 0::BIGINT AS train, 0::BIGINT AS valid
  UNION ALL
  SELECT g.r, g.key,
         CASE WHEN train + n <= tc THEN 'train' WHEN train + valid + n <= vc THEN 'valid' ELSE 'test' END,
         CASE WHEN train + n <= tc THEN train + n ELSE train END,
         CASE WHEN train + n > tc AND train + valid + n <= vc THEN valid + n ELSE valid END
  FROM walk JOIN groups g ON g.r = walk.r + 1, caps)
"""


def _grouped(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", group_key().alias("key"))
    return group_split(docs, "key")


@register("group_split", f"WITH RECURSIVE {FILL_SQL} SELECT doc_id, split FROM keyed JOIN walk USING (key)")
def by_group(spark, sf_dir):
    return _grouped(spark, sf_dir).select("doc_id", "split")


@register(
    "group_split_summary",
    f"""
    WITH RECURSIVE {FILL_SQL}
    SELECT split, count(*) AS n_rows, count(DISTINCT key) AS n_groups FROM keyed JOIN walk USING (key) GROUP BY 1
    """,
)
def group_summary(spark, sf_dir):
    per_group = _grouped(spark, sf_dir).groupBy("split", "key").agg(F.count(F.lit(1)).alias("n"))
    return per_group.groupBy("split").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"))


@register(
    "two_core",
    f"""
    WITH {GRAPH_SQL}
    SELECT mol, src, dst, kind FROM bonds JOIN sizes USING (mol)
    WHERE n - 1 - n // 3 >= 2 AND src >= n // 3
    """,
)
def core(spark, sf_dir):
    return two_core(molecule_graphs(spark, sf_dir)[1])


@register(
    "graph_group_key",
    f"""
    WITH {GRAPH_SQL},
    core AS (SELECT mol, src, dst, kind FROM bonds JOIN sizes USING (mol)
             WHERE n - 1 - n // 3 >= 2 AND src >= n // 3),
    hashed AS (
      SELECT core.mol, ('0x' || substr(md5(least(a.symbol, b.symbol) || '|' || greatest(a.symbol, b.symbol)
                                           || '|' || kind), 1, 15))::BIGINT AS h
      FROM core JOIN atoms a ON core.mol = a.mol AND src = a.pos JOIN atoms b ON core.mol = b.mol AND dst = b.pos),
    digests AS (
      SELECT mol, md5(count(*) || ':' || bit_xor(h) || ':' || sum(h % 2147483648)) AS group_key FROM hashed GROUP BY 1)
    SELECT mol, coalesce(group_key, '') AS group_key FROM sizes LEFT JOIN digests USING (mol)
    """,
)
def molecule_keys(spark, sf_dir):
    atoms, bonds = molecule_graphs(spark, sf_dir)
    return graph_key(bonds, atoms)


# part stands in for written molecules: six-rings of c and n after a chain, two fused and two linked rings, chains.
WRITTEN_SQL = """
written AS (
  SELECT p_partkey AS mol, p_partkey % 4 AS form, p_size,
         concat(CASE WHEN p_partkey // 4 % 2 = 1 THEN 'n' ELSE 'c' END, CASE WHEN p_partkey // 8 % 2 = 1 THEN 'n' ELSE 'c' END,
                CASE WHEN p_partkey // 16 % 2 = 1 THEN 'n' ELSE 'c' END, CASE WHEN p_partkey // 32 % 2 = 1 THEN 'n' ELSE 'c' END,
                CASE WHEN p_partkey // 64 % 2 = 1 THEN 'n' ELSE 'c' END, CASE WHEN p_partkey // 128 % 2 = 1 THEN 'n' ELSE 'c' END) AS ring
  FROM part)
"""
_TURNS = ", ".join(f"substr({r} || {r}, {i}, 6)" for r in ("ring", "reverse(ring)") for i in range(1, 7))


def written_molecules(spark, sf_dir):
    """``mol, sequence``; a ring is written from another atom in every size."""
    bits = [F.when(F.expr(f"p_partkey div {4 << i} % 2") == 1, "n").otherwise("c") for i in range(6)]
    ring = F.concat(*bits)
    turned = F.substr(F.concat(ring, ring), F.expr("cast(p_size % 6 as int)") + 1, F.lit(6))
    closed = F.concat(F.left(turned, F.lit(1)), F.lit("1"), F.substring(turned, 2, 5), F.lit("1"))
    form = F.col("p_partkey") % 4
    text = (
        F.when(form == 0, F.concat(F.expr("repeat('C', cast(p_size % 5 as int))"), closed))
        .when(form == 1, "C1CCC2CCCCC2C1")
        .when(form == 2, "C1CCC(C)(C)1C1CCCC1")
        .otherwise(F.expr("repeat('C', cast(p_size as int))"))
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("mol"), text.alias("sequence"))


@register(
    "scaffold_groups",
    f"""
    WITH {WRITTEN_SQL},
    keyed AS (SELECT mol, CASE form WHEN 0 THEN list_min([{_TURNS}]) WHEN 1 THEN 'fused' WHEN 2 THEN 'linked' ELSE '' END AS key FROM written)
    SELECT mol, min(mol) OVER (PARTITION BY key) AS first_mol, count(*) OVER (PARTITION BY key) AS n_mols, key <> '' AS cyclic FROM keyed
    """,
)
def scaffold_groups(spark, sf_dir):
    atoms, bonds = atoms_bonds(written_molecules(spark, sf_dir), "mol", "sequence")
    keys = scaffold_key(bonds, atoms)
    groups = keys.groupBy("group_key").agg(F.min("mol").alias("first_mol"), F.count(F.lit(1)).alias("n_mols"))
    return keys.join(groups, "group_key").select("mol", "first_mol", "n_mols", (F.col("group_key") != "").alias("cyclic"))


@register("hash_split", f"SELECT o_orderkey, {split_sql('o_orderkey', 42)} AS split FROM orders")
def by_hash(spark, sf_dir):
    return hash_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 42)


@register(
    "contiguous_parts",
    """
    WITH n AS (SELECT count(*) AS n FROM orders),
    numbered AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders)
    SELECT o_orderkey, (idx * 7) // n AS part FROM numbered, n
    """,
)
def contiguous(spark, sf_dir):
    return contiguous_parts(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 7)


@register(
    "worker_shard",
    """
    SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) % 6 AS worker FROM orders
    """,
)
def workers(spark, sf_dir):
    return worker_shard(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 6)


@register(
    "minibatches",
    """
    WITH numbered AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents)
    SELECT doc_id, idx // 32 AS batch_id, idx % 32 AS in_batch FROM numbered
    """,
)
def batches(spark, sf_dir):
    return minibatches(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 32)


@register(
    "split_audit",
    f"""
    WITH s AS (SELECT doc_id, {GROUP_KEY} AS key, {split_sql('doc_id')} AS split FROM documents),
    torn AS (SELECT key FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1),
    torn_ids AS (SELECT doc_id FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1)
    SELECT count(*) AS n_rows, count(*) FILTER (split IS NULL) AS n_unassigned,
           (SELECT count(*) FROM torn_ids) AS ids_in_many, (SELECT count(*) FROM torn) AS groups_in_many
    FROM s
    """,
)
def audit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", group_key().alias("key"))
    return audit_split(hash_split(docs, "doc_id"), "doc_id", "key")


@register(
    "row_index",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS idx FROM orders",
)
def numbered(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return row_index(orders, ["o_orderdate", "o_orderkey"]).drop("o_orderdate")
