"""Every registered query against its SQL, over whole small tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import TESTDATA, compare, duck

SF_DIR = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_agrees_with_sql(spark, con, name):
    result = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF_DIR)
    assert result.split()[0] in ("ok", "rows-only"), result
    assert int(result.split()[1]) > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["split"] for r in rows} == {"train", "valid", "test"}
    assert sum(r["n_rows"] for r in rows) > 100


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


ORDERED = [
    "shard_sizes", "merge_shard_metadata", "shard_assignment", "cadence_filter", "roc_auc_by_task", "group_split",
    "contiguous_parts", "worker_shard", "minibatches", "row_index", "global_step", "windowed_loss", "early_stop",
    "improvement_trail", "subset_exact_n", "pad_and_mask", "vocab_tokens", "atoms_bonds", "negative_edges",
    "vocab_node_context", "stream_early_stop",
]


@pytest.mark.parametrize("name", ORDERED)
def test_many_slices_give_the_same_rows(spark, con, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        result = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF_DIR)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert result.startswith("ok"), result
