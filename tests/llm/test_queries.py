"""Registered queries over whole small tables, and the pipeline."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from molframe.llm.queries import LLM_ORACLE, LLM_QUERIES
from tests.compare import TESTDATA, compare, duck

SF_DIR = f"{TESTDATA}/sf0.001"


def test_all_are_registered():
    assert {n.split("_")[0] for n in LLM_QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(LLM_QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_query_agrees_with_sql(spark, name):
    result = compare(spark, duck(SF_DIR), name, LLM_QUERIES[name], LLM_ORACLE[name], SF_DIR)
    assert result.startswith("ok"), result


def test_stages_keep_columns_and_only_drop_or_repeat(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = corpus_pipeline.cut(stage(spark, docs, SF_DIR))
        assert after.columns == docs.columns, name
        n = after.count()
        assert n <= 2 * before if name == "mixing" else n <= before
        if name == "secrets":
            assert n == before
        docs, before = after, n
