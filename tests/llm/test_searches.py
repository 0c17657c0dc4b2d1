"""Vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from molframe.llm import covertree, permutation
from molframe.llm.vectors import vector_table

KIND = "vec_id bigint, embedding array<float>, score string, v int"


def vectors(spark, n, dim=8, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[:copies] = x[0]
    rows = [(i, x[i].tolist(), "extra", 1) for i in range(n)]
    odd = [(n, None, "", 1), (n + 1, [float("nan")] * dim, "", 1), (n + 2, [1.0] * (dim - 1) + [None], "", 1)]
    odd += [(None, x[0].tolist(), "", 1), (n + 3, [float("inf")] * dim, "", 1), (n + 4, [], "", 1), (n + 5, [1.0], "", 1)]
    return x, spark.createDataFrame(rows + odd, KIND)


def expected(x, q, k=20):
    s = (x * x[q]).sum(axis=1)
    order = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:k]
    return [(int(i), s[i]) for i in order]


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("n, copies", [(700, 240), (9, 0)])
def test_dual_tree_is_exact(spark, monkeypatch, n, copies):
    # Small cells and leaves, so that trees, groups and pruning all take part.
    monkeypatch.setattr(covertree, "CELL", 150)
    monkeypatch.setattr(covertree, "GROUP", 10)
    monkeypatch.setattr(covertree, "LEAF", 16)
    x, df = vectors(spark, n, copies=copies)
    whole = np.floor(64 * x.astype(np.float64)).astype(np.int64)
    got = found(covertree.search(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0))
    assert got == {q: expected(whole, q) for q in range(0, n, 20)}


def test_bound_holds():
    rng = np.random.default_rng(1)
    for _ in range(50):
        q, r = rng.normal(size=(30, 5)), rng.normal(size=(30, 5)) * 3
        top = covertree.bound(q[0], covertree.distances(q, q[0]).max(), r[0], covertree.distances(r, r[0]).max())
        assert (q @ r.T).max() <= top


@pytest.mark.parametrize("n, dim, copies", [(1500, 16, 500), (4000, 64, 0), (6000, 64, 2000)])
def test_permutation_recall_and_scores(spark, n, dim, copies):
    """Production parameters; a third of the rows may be one vector."""
    x, df = vectors(spark, n, dim=dim, copies=copies)
    wide = x.astype(np.float64)
    got = found(permutation.search(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0))
    hits = total = 0
    for q, rows in got.items():
        best = expected(wide, q)
        assert len(rows) == 20 and all(s == (wide[i] * wide[q]).sum() for i, s in rows)
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))
        hits += len({i for i, _ in rows} & {i for i, _ in best})
        total += 20
    assert len(got) == n // 20 and hits / total >= 0.9
    if copies:
        # Copies find each other, the smallest ids first, and not themselves.
        assert [i for i, _ in got[20]] == [i for i in range(21) if i != 20]


def test_equal_vectors_are_one_entry(spark):
    x, df = vectors(spark, 300, copies=100)
    rows = {r["entry"]: r["ids"] for r in permutation.entries(vector_table(df, "vec_id", "embedding"), 5).collect()}
    assert rows == {0: [0, 1, 2, 3, 4]} | {i: [i] for i in range(100, 300)}


def test_few_and_zero_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, -0.0]), (2, [0.5, 2.0]), (2, [0.5, 2.0])], "vec_id bigint, embedding array<float>")
    assert found(permutation.search(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0)) == {0: [(2, 0.5)]}
    assert vector_table(df, "vec_id", "embedding").count() == 3


def test_empty_tables(spark):
    none = spark.createDataFrame([], KIND)
    assert covertree.search(none, "vec_id", "embedding", F.col("vec_id") % 20 == 0).count() == 0
    assert permutation.search(none, "vec_id", "embedding", F.col("vec_id") % 20 == 0).count() == 0
