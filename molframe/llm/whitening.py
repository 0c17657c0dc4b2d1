"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

1. Entries become integers, floor(SCALE * c). Each distinct vector counts once:
   copies combine before the shuffle.
2. Tasks add up products of entries exactly and send them as 32-bit limbs, which
   Spark sums by entry; the driver sees one row for each pair of dimensions. The
   scatter ``n * sum(x x') - S S'``, n squared times the covariance, is integer.
3. Its characteristic polynomial is computed modulo enough primes, dealt out to
   tasks, by reduction to Hessenberg form, and put together by Chinese remainders.
4. The largest roots are isolated by exact counts of sign changes and refined to
   200 bits; each root's null space, again one task a root, is found by inverse
   iteration in fixed point (``charpoly``). Roots may repeat: their vectors are
   then any orthonormal basis, the same for all rows.
5. Rows are projected where they lie, and the covariance of the whitened fit list
   is measured against the identity in one more pass.

What reaches the driver is bounded by the dimension, never by the rows.

Rows: a vector that is null or empty, or holds null, NaN, infinite entries or
entries of 2**62 / SCALE and more in size, takes no part, nor does one of another
length than the most frequent (of equally frequent, the shorter). Every other row
gives its result, repeated and null ids too; equal vectors get equal results.
Components are those of positive variance, so there are fewer than asked for if
the vectors span less, and none if all are equal: the result is then empty, as it
is for an empty table. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import gcd, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molframe.llm import charpoly
from molframe.llm.registry import column
from molframe.plans.lineage import cut

SCALE = 64
#: A sum of products is sent in so many limbs of 32 bits; the last carries the sign.
LIMBS, LIMB_BITS = 6, 32
LONG = (1 << 63) - 1


def whole_entries(vector: Column) -> Column:
    """floor(SCALE * c) of each entry; null for a vector that takes no part."""
    entries = vector.cast("array<double>")
    usable = F.forall(entries, lambda c: c.isNotNull() & (F.abs(c * SCALE) < float(1 << 62)))
    return F.when((F.size(entries) > 0) & usable, F.transform(entries, lambda c: F.floor(c * SCALE).cast("bigint")))


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with their column ``x`` as a matrix; empty ones are left out."""
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def products(x: np.ndarray) -> np.ndarray:
    """Exact sums of products of the columns."""
    most = int(np.abs(x).max())
    if most * most * len(x) < 1 << 53:
        y = x.astype(np.float64)  # every partial sum is an integer that a double holds
        return (y.T @ y).astype(np.int64).astype(object)
    y = x.astype(object)
    return y.T.dot(y)


def _limbs(value: int) -> list[int]:
    low = [(value >> (LIMB_BITS * k)) & ((1 << LIMB_BITS) - 1) for k in range(LIMBS - 1)]
    return [*low, value >> (LIMB_BITS * (LIMBS - 1))]


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``i, j`` and limbs: pair sums, with j = -1 sums of a dimension, with both -1 the number of rows."""
    n, sums, pairs = 0, None, None
    for _, x in matrices(batches):
        s, p = x.astype(object).sum(axis=0), products(x)
        n += len(x)
        sums, pairs = (s, p) if sums is None else (sums + s, pairs + p)
    if n:
        size = len(sums)
        cells = [(-1, -1, n), *((i, -1, sums[i]) for i in range(size))]
        cells += [(i, j, pairs[i, j]) for i in range(size) for j in range(i, size)]
        limbs = np.array([_limbs(int(v)) for *_, v in cells], np.int64)
        at = np.array([c[:2] for c in cells], np.int32)
        names = ["i", "j", *(f"l{k}" for k in range(LIMBS))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*at.T, *limbs.T)], names)


LIMB_SCHEMA = "i int, j int, " + ", ".join(f"l{k} bigint" for k in range(LIMBS))


def scatter(fit: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """Rows, sums by dimension, and the integer scatter of column ``x``."""
    summed = fit.mapInArrow(_summed, LIMB_SCHEMA).groupBy("i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)])
    cells = {(r["i"], r["j"]): sum(r[f"l{k}"] << (LIMB_BITS * k) for k in range(LIMBS)) for r in summed.collect()}
    n = cells.get((-1, -1), 0)
    size = 1 + max((i for i, _ in cells), default=-1)
    sums = [cells[i, -1] for i in range(size)]
    matrix = [[n * cells[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(size)] for i in range(size)]
    return n, sums, matrix


def dealt(spark: SparkSession, count: int, work: Callable[[int], list[float] | list[int]], kind: str) -> list[list]:
    """``work`` of 0 .. count - 1, done by tasks; results in order."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for numbers in batches:
            done = [work(int(k)) for k in numbers["id"]]
            yield pd.DataFrame({"id": numbers["id"], "value": done})

    slices = max(1, min(count, 4 * spark.sparkContext.defaultParallelism))
    rows = spark.range(0, count, 1, slices).mapInPandas(each, f"id bigint, value array<{kind}>").collect()
    return [list(r["value"]) for r in sorted(rows, key=lambda r: r["id"])]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(tI - matrix), lowest first, of a positive semidefinite integer matrix."""
    primes = charpoly.primes_beyond(2 * charpoly.coefficient_bound(matrix) + 1)
    residues = dealt(spark, len(primes), lambda k: charpoly.charpoly_mod(matrix, primes[k]), "bigint")
    return charpoly.from_residues(residues, primes)


@dataclass(frozen=True)
class Whitening:
    """n and S of the fit list; of each component its share of the variance, its vector and the root of its scatter."""

    n: int
    sums: tuple[int, ...]
    explained: tuple[float, ...]
    vectors: np.ndarray
    scales: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        if self.n * int(np.abs(x).max()) + max(map(abs, self.sums)) < LONG:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, dtype=object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """One row for each vector, one column for each component; a scatter's root is n times a deviation."""
        return centred.astype(np.float64) @ self.vectors / self.scales

    def project(self, rows: DataFrame) -> DataFrame:
        """``id, deviation, whitened`` of ``id, x``: sum of squares of n * x - S, and one number a component."""

        def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, x in matrices(batches):
                far = self.centred(x)
                z = self.whitened(far)
                if far.dtype != object and int(np.abs(far).max()) ** 2 * far.shape[1] > LONG:
                    far = far.astype(object)
                squares = [str(int(v)) for v in (far * far).sum(axis=1)]
                ends = np.arange(0, z.size + 1, z.shape[1], dtype=np.int32)
                lists = pa.ListArray.from_arrays(ends, pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(squares), lists], ["id", "deviation", "whitened"])

        kind = rows.schema["id"].dataType.simpleString()
        done = rows.select("id", "x").mapInArrow(projected, f"id {kind}, deviation string, whitened array<double>")
        return done.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))

    def identity_error(self, fit: DataFrame) -> float:
        """Largest entry, in size, of the covariance of the whitened fit list minus the identity."""

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for _, x in matrices(batches):
                z = self.whitened(self.centred(x))
                # A column of ones adds the sums to the sums of products.
                z = np.column_stack([z, np.ones(len(z))])
                total = z.T @ z if total is None else total + z.T @ z
            if total is not None:
                i, j = np.indices(total.shape, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c.ravel()) for c in (i, j, total)], ["i", "j", "v"])

        cells = fit.mapInArrow(summed, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
        size = len(self.scales)
        total = np.zeros((size + 1, size + 1))
        for r in cells:
            total[r["i"], r["j"]] = r["v"] / self.n
        mean = total[:size, size]
        return float(np.abs(total[:size, :size] - np.outer(mean, mean) - np.eye(size)).max())


def integer_rows(df: DataFrame, id: str, vector: str) -> DataFrame:
    """``id, x`` of the rows that take part, written to the shared folder."""
    rows = df.select(column(id).alias("id"), whole_entries(column(vector)).alias("x")).filter("x IS NOT NULL")
    rows = cut(rows)
    # One row per length is sorted, one number reaches the driver.
    lengths = rows.groupBy(F.size("x").alias("n")).agg(F.count(F.lit(1)).alias("c"))
    usual = lengths.orderBy(F.desc("c"), "n").limit(1).collect()
    return rows.filter(F.size("x") == (usual[0]["n"] if usual else 0))


def fit_whitening(fit: DataFrame, components: int = 16) -> Whitening | None:
    """Whitening by the ``components`` of most variance of distinct vectors ``x``; None if all are equal or none is there."""
    spark = fit.sparkSession
    n, sums, matrix = scatter(fit)
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    if trace == 0:
        return None
    # What all entries share is put back into the roots.
    shared = gcd(*(v for row in matrix for v in row))
    matrix = [[v // shared for v in row] for row in matrix]
    roots = charpoly.largest_roots(characteristic_polynomial(spark, matrix), components)
    # Rows of a list of numbers are easier to send than of a matrix.
    spaces = dealt(spark, len(roots), lambda k: charpoly.null_vectors(matrix, *roots[k]).T.ravel().tolist(), "double")
    vectors = np.vstack([np.array(s).reshape(m, -1) for s, (_, m) in zip(spaces, roots)])[:components]
    # Either sign would do; the largest entry is made positive.
    vectors *= np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]
    values = [r * shared for r, m in roots for _ in range(m)][:components]
    explained = tuple(float(Fraction(v) / trace) for v in values)
    return Whitening(n, tuple(sums), explained, vectors.T, np.array([sqrt(v) for v in values]))


RESULT = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"


def whiten(df: DataFrame, id: str, vector: str, components: int = 16) -> DataFrame:
    """One row for each row that takes part and each component, as RESULT after the id.

    ``deviation`` is null where it exceeds a long (from some 10 million distinct
    vectors on); ``deviation_exact`` holds it.
    """
    rows = integer_rows(df, id, vector)
    fit = cut(rows.select("x").distinct())
    model = fit_whitening(fit, components)
    if model is None:
        kind = rows.schema["id"].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"`{id}` {kind}, {RESULT}")
    error = model.identity_error(fit)
    shares = F.array(*[F.lit(v) for v in model.explained])
    long = model.project(rows).select(column("id"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(
        F.col("id").alias(id),
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        F.when(F.col("deviation") <= LONG, F.col("deviation")).cast("bigint").alias("deviation"),
        "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
        F.col("deviation").alias("deviation_exact"),
    )
