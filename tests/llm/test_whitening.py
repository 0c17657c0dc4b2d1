"""Whitening against plain numpy, and its polynomial against small exact cases."""

from fractions import Fraction

import numpy as np
import pytest

from molframe.llm import charpoly, whitening
from tests.compare import TESTDATA

KIND = "vec_id bigint, embedding array<float>, component string, id int, x string"


def frame(spark, vectors, extra=()):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], "c", 1, "x") for i, v in enumerate(vectors)]
    return spark.createDataFrame([*rows, *extra], KIND)


def expected(vectors, components=16):
    """n, S, deviations, shares and whitened rows, the vectors taken as they come."""
    x = np.floor(64 * np.asarray(vectors, np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    far = n * x - sums
    centred = (n * fit - sums) / n
    values, spaces = np.linalg.eigh(centred.T @ centred / n)
    values, spaces = values[::-1], spaces[:, ::-1]
    k = min(components, int((values > values[0] * 1e-9).sum()))
    return n, (far**2).sum(axis=1), values[:k] / values.sum(), far / n @ spaces[:, :k] / np.sqrt(values[:k])


def check(got, vectors, separate=True):
    n, deviations, shares, z = expected(vectors)
    rows = {(r["vec_id"], r["component"]): r for r in got.collect()}
    assert len(rows) == got.count() == z.size
    mine = np.array([[rows[i, k + 1]["whitened"] for k in range(z.shape[1])] for i in range(len(z))])
    first = [rows[0, k + 1] for k in range(z.shape[1])]
    assert {r["n"] for r in rows.values()} == {n} and len({r["identity_error"] for r in rows.values()}) == 1
    assert first[0]["identity_error"] < 1e-9
    assert np.allclose([r["explained"] for r in first], shares, rtol=1e-9)
    assert [rows[i, 1]["deviation"] for i in range(len(z))] == deviations.tolist()
    assert [int(rows[i, 1]["deviation_exact"]) for i in range(len(z))] == deviations.tolist()
    if separate:
        signs = np.sign((mine * z).sum(axis=0))
        assert np.allclose(mine, z * signs, atol=1e-7)
    return mine


def test_given_vectors(spark):
    df = spark.read.parquet(f"{TESTDATA}/sf0.01/embeddings.parquet")
    vectors = {r["vec_id"]: r["embedding"] for r in df.collect()}
    check(whitening.whiten(df, "vec_id", "embedding"), [vectors[i] for i in range(len(vectors))])


def test_copies_ties_and_rows_left_out(spark):
    rng = np.random.default_rng(3)
    some = rng.normal(0, 0.3, (40, 5))
    vectors = [*some, *[some[0]] * 30, *some[:7]]
    odd = [None, [1, None, 2, 3, 4], [1, float("nan"), 2, 3, 4], [float("inf")] * 5, [1, 2], [], [1e30] * 5]
    check(whitening.whiten(frame(spark, [*vectors, *odd]), "vec_id", "embedding"), vectors)


def test_equal_roots_and_less_than_full_rank(spark):
    cross = [s * row for s in (0.5, -0.5) for row in np.eye(20)]
    mine = check(whitening.whiten(frame(spark, cross), "vec_id", "embedding"), cross, separate=False)
    assert mine.shape == (40, 16)
    flat = np.c_[np.random.default_rng(5).normal(0, 1, (30, 2)), np.zeros((30, 3))]
    assert check(whitening.whiten(frame(spark, flat), "vec_id", "embedding"), flat).shape == (30, 2)


def test_ids_may_repeat_or_be_null(spark):
    again = [(None, [3.0, 1.0], "c", 1, "x"), (0, [1.0, 5.0], "c", 1, "x")]
    got = whitening.whiten(frame(spark, [[1, 2], [2, 2], [4, 1]], again), "vec_id", "embedding").collect()
    assert len(got) == 10 and sum(r["vec_id"] is None for r in got) == 2 and sum(r["vec_id"] == 0 for r in got) == 4


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[]]])
def test_nothing_to_whiten(spark, vectors):
    got = whitening.whiten(frame(spark, vectors), "vec_id", "embedding")
    assert got.columns[0] == "vec_id" and got.count() == 0


def test_large_entries_stay_exact(spark):
    vectors = [[float(1 << 50), 1.0], [0.0, 2.0], [-float(1 << 49), 5.0]]
    got = whitening.whiten(frame(spark, vectors), "vec_id", "embedding").collect()
    x = [[int(64 * c) for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*x)]
    exact = {i: sum((3 * c - s) ** 2 for c, s in zip(v, sums)) for i, v in enumerate(x)}
    assert {(r["vec_id"], int(r["deviation_exact"])) for r in got} == set(exact.items())
    assert all(r["deviation"] is None for r in got)


def test_polynomial_of_known_roots():
    # (t - 1)^2 (t - 3) t
    assert charpoly.largest_roots([0, -3, 7, -5, 1], 9)[0][0] - 3 < Fraction(1, 1 << 190)
    assert [m for _, m in charpoly.largest_roots([0, -3, 7, -5, 1], 9)] == [1, 2]
    rng = np.random.default_rng(1)
    a = rng.integers(-9, 9, (6, 9)).astype(object)
    m = a.dot(a.T).tolist()
    primes = charpoly.primes_beyond(2 * charpoly.coefficient_bound(m) + 1)
    poly = charpoly.from_residues([charpoly.charpoly_mod(m, p) for p in primes], primes)
    assert np.allclose([float(c) for c in poly[::-1]], np.poly(np.array(m, float)), rtol=1e-8)
    # Cayley and Hamilton: the matrix solves its own polynomial.
    power, total = np.eye(6, dtype=int).astype(object), np.zeros((6, 6), dtype=object)
    for c in poly:
        total, power = total + c * power, power.dot(np.array(m, dtype=object))
    assert not total.any()


def test_reduction_meets_zero_pivots():
    m = [[2, 0, 0, 1], [0, 3, 0, 0], [0, 0, 4, 0], [1, 0, 0, 5]]
    p = charpoly.primes_beyond(1)[0]
    signed = [c - p if c > p // 2 else c for c in charpoly.charpoly_mod(m, p)]
    assert np.allclose(signed[::-1], np.poly(np.array(m, float)))
