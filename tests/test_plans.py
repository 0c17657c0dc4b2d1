"""Shape of the plans: pushdown, pruning, no single-task steps over data."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from molframe.operators.clean import clean_by_length
from molframe.operators.features import featurize
from molframe.operators.joins import attach_labels
from tests.compare import TESTDATA

SF_DIR = f"{TESTDATA}/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_the_columns_used(spark):
    text = plan(entry.queries()["label_attach"](spark, SF_DIR))
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in text


def test_filters_reach_the_scan(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan(docs.filter("lang = 'en'").select("doc_id"))
    joined = attach_labels(docs.select("doc_id", "lang"), spark.read.parquet(f"{SF_DIR}/labels.parquet"), "doc_id").filter("lang = 'en'")
    assert "EqualTo(lang,en)" in plan(joined)


def test_length_filter_runs_below_the_user_function(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    found = clean_by_length(featurize(docs, lambda s: s.str.len().map(lambda n: [float(n)]), "text", "array<double>"), "text", 100)
    lines = plan(found).splitlines()
    udf = next(i for i, line in enumerate(lines) if "ArrowEvalPython" in line)
    assert any("length(text" in line and "Filter" in line for line in lines[udf + 1 :])


SHUFFLE_FREE = ["tokenize", "feat_hashed_fp", "descriptors", "mlm_mask", "hash_split", "clean_by_length", "first_match_rewrite", "uri_parts", "props_json"]


@pytest.mark.parametrize("name", SHUFFLE_FREE)
def test_row_local_features_do_not_shuffle(spark, name):
    exchanges = [line for line in plan(entry.queries()[name](spark, SF_DIR)).splitlines() if "Exchange" in line]
    # Only the evening-out of a scan with fewer splits than cores is allowed.
    assert all("REPARTITION_BY_NUM" in line for line in exchanges), exchanges


AGGREGATES = ["clean_report", "dataset_summary", "group_sizes", "triplicate_summary", "best_checkpoint", "node_degree", "pearson_r2"]


@pytest.mark.parametrize("name", AGGREGATES)
def test_aggregates_combine_before_the_shuffle(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    # One task sees the ends of the slices at most: one row per slice.
    assert "partial_" in text and text.count("SinglePartition") <= text.count("windowspecdefinition(_slice")


def test_no_query_has_a_cross_join(spark):
    for name in ("experiment_grid", "shard_assignment", "rmse_denormalized", "early_stop", "pairs_within_2"):
        text = plan(entry.queries()[name](spark, SF_DIR))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_known_bounds_for_broadcast(spark):
    """With many slices, only the keys that span slices and the carry table are broadcast by hint."""
    from molframe.plans.ordered import Running, running, slice_by_range

    df = spark.range(2000).withColumn("k", F.col("id") % 5)
    sliced = slice_by_range(df, ["id"], ["k"], 10)
    text = running(sliced, n=Running("count"))._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in text


def test_reading_molecules_shuffles_the_strings_only(spark):
    from molframe.operators.graph import atoms_bonds

    df = spark.createDataFrame([(1, "CC1CC1")], "id int, smi string")
    atoms, bonds = atoms_bonds(df, "id", "smi")
    for table in (atoms, bonds):
        text = plan(table)
        assert "Join" not in text and text.count("Exchange") == 1
    # Along the string, along its branches, along the uses of each ring label.
    assert plan(bonds).count("Sort [") == 3


def test_statistics_do_not_shuffle_the_rows(spark):
    from molframe.operators.transform import attach_stats

    rows = spark.range(10**11).select("id", (F.col("id") % 3).alias("task"))
    stats = rows.groupBy("task").agg(F.avg("id").alias("m"))
    text = plan(attach_stats(rows, stats))
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text
