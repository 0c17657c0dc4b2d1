"""Characteristic polynomial, roots and null vectors of a symmetric integer matrix, exactly or nearly so.

Plain functions of numbers: Spark deals the primes and the roots out to tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from math import isqrt

import numpy as np

#: Bits of working precision beyond those of the matrix, and relative bits of a root.
SPARE_BITS, ROOT_BITS = 320, 200


def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that settle every n below 3.4e14."""
    if n < 2 or any(n % p == 0 and n != p for p in (2, 3, 5, 7, 11, 13, 17)):
        return False
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7, 11, 13, 17):
        x = pow(base, odd, n)
        if base % n and x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes just below 2**31 whose product exceeds ``bound``."""
    found, product, at = [], 1, (1 << 31) - 1
    while product <= bound:
        if is_prime(at):
            found.append(at)
            product *= at
        at -= 2
    return found


def coefficient_bound(matrix: list[list[int]]) -> int:
    """No coefficient of the polynomial of a positive semidefinite matrix is larger.

    They are the elementary symmetric functions of roots of known sum, whose
    total is greatest when the roots are equal.
    """
    size = len(matrix)
    mean = -(-sum(matrix[i][i] for i in range(size)) // size)
    return (1 + mean) ** size


def charpoly_mod(matrix: list[list[int]], p: int) -> list[int]:
    """Coefficients, lowest first, of det(tI - matrix) modulo a prime below 2**31."""
    a = np.array([[v % p for v in row] for row in matrix], np.int64)
    size = len(a)
    # Similar matrix of Hessenberg form: zeros below the first subdiagonal.
    for k in range(size - 2):
        below = np.flatnonzero(a[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            a[[k + 1, pivot]] = a[[pivot, k + 1]]
            a[:, [k + 1, pivot]] = a[:, [pivot, k + 1]]
        factor = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :] = (a[k + 2 :] - factor[:, None] * a[k + 1][None, :] % p) % p
        # Products stay below p, so a sum of all of them fits 64 bits.
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * factor[None, :] % p).sum(axis=1)) % p
    # Polynomials of the leading blocks, each from those before it.
    polys = np.zeros((size + 1, size + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, size + 1):
        polys[k, 1:] = polys[k - 1, :-1]
        weights = np.zeros(k, np.int64)
        chain = 1
        for i in range(k - 1, -1, -1):
            weights[i] = int(a[i, k - 1]) * chain % p
            chain = chain * int(a[i, i - 1]) % p if i else 0
        polys[k] = (polys[k] - (weights[:, None] * polys[:k] % p).sum(axis=0)) % p
    return polys[size].tolist()


def from_residues(residues: Sequence[Sequence[int]], primes: Sequence[int]) -> list[int]:
    """Integers of least size with these residues, one row for each prime (Chinese remainders)."""
    product = 1
    for p in primes:
        product *= p
    parts = [(product // p) * pow(product // p, -1, p) for p in primes]
    out = []
    for column in zip(*residues):
        value = sum(r * part for r, part in zip(column, parts)) % product
        out.append(value - product if value > product // 2 else value)
    return out


def roots_above(poly: Sequence[int], at: Fraction) -> int:
    """Number of roots beyond ``at``, with multiplicity, of a polynomial that has real roots only.

    The sign changes of the polynomial shifted to ``at`` count them exactly.
    """
    num, den = at.numerator, at.denominator
    # Coefficients of den**n * poly(t / den), shifted by num.
    size = len(poly) - 1
    c = [v * den ** (size - i) for i, v in enumerate(poly)]
    for i in range(size):
        for j in range(size - 1, i - 1, -1):
            c[j] += num * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _sign(poly: Sequence[int], num: int, shift: int) -> int:
    """Sign of the polynomial at num / 2**shift."""
    value, size = 0, len(poly) - 1
    for i in range(size, -1, -1):
        value = value * num + (poly[i] << (shift * (size - i)))
    return (value > 0) - (value < 0)


def largest_roots(poly: Sequence[int], count: int) -> list[tuple[Fraction, int]]:
    """The ``count`` largest positive roots, falling, as (root, multiplicity); the last group is whole.

    ``poly`` has integer coefficients, lowest first, and no roots but real ones
    that are not negative. Intervals are halved by exact counts until each holds
    one root, then by the sign alone. Roots that agree in ROOT_BITS relative bits
    are one root of that multiplicity.
    """
    zeros = next(i for i, v in enumerate(poly) if v)
    poly = list(poly[zeros:])
    size = len(poly) - 1
    wanted = min(count, size)
    if not wanted:
        return []
    high = 1 << (-poly[-2] // poly[-1]).bit_length()  # their sum
    found: list[tuple[Fraction, int]] = []
    # (low, high, roots above low, roots above high), the highest interval last.
    open_intervals = [(Fraction(0), Fraction(high), size, 0)]
    while open_intervals and sum(m for _, m in found) < wanted:
        low, top, above_low, above_top = open_intervals.pop()
        inside = above_low - above_top
        if inside == 0:
            continue
        if low and (top - low) * (1 << ROOT_BITS) < low:
            found.append(((low + top) / 2, inside))
        elif inside == 1 and low:
            found.append((_refined(poly, low, top), 1))
        else:
            mid = (low + top) / 2
            above_mid = roots_above(poly, mid)
            open_intervals += [(low, mid, above_low, above_mid), (mid, top, above_mid, above_top)]
    return found


def _refined(poly: Sequence[int], low: Fraction, top: Fraction) -> Fraction:
    """The only root in (low, top], by halving on the sign; both ends are dyadic."""
    shift = max(low.denominator, top.denominator).bit_length() - 1
    a, b = int(low * (1 << shift)), int(top * (1 << shift))
    at_top = _sign(poly, b, shift)
    if at_top == 0:
        return top
    while (b - a) << ROOT_BITS > a:
        a, b, shift = 2 * a, 2 * b, shift + 1
        mid = (a + b) // 2
        sign = _sign(poly, mid, shift)
        if sign == 0:
            return Fraction(mid, 1 << shift)
        a, b = (a, mid) if sign == at_top else (mid, b)
    return Fraction(a + b, 2 << shift)


def null_vectors(matrix: list[list[int]], root: Fraction, count: int) -> np.ndarray:
    """Orthonormal columns that span the space of one root of a symmetric matrix.

    Inverse iteration on the whole space at once, in fixed point with SPARE_BITS
    beyond the matrix: the matrix less the root is singular but for the root's
    last bits, so two solutions leave the null space alone.
    """
    size = len(matrix)
    bits = SPARE_BITS + max(abs(v) for row in matrix for v in row).bit_length()
    one = 1 << bits
    shift = (root.numerator << bits) // root.denominator
    a = np.array([[v << bits for v in row] for row in matrix], dtype=object)
    for i in range(size):
        a[i, i] -= shift
    rng = np.random.default_rng(size)
    b = np.array([[int(v) << bits for v in row] for row in rng.integers(1, 1 << 30, (size, count))], dtype=object)
    lower, order = _factored(a, bits)
    for _ in range(2):
        b = _orthonormal(_solved(a, lower, order, b, bits), bits)
    return np.array([[float(Fraction(int(v), one)) for v in row] for row in b])


def _factored(a: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[int]]:
    """Rows exchanged and reduced in place; the factors and exchanges of each column."""
    size, lower, order = len(a), [], []
    for k in range(size):
        pivot = max(range(k, size), key=lambda i: abs(a[i, k]))
        a[[k, pivot]] = a[[pivot, k]]
        order.append(pivot)
        if a[k, k] == 0:
            a[k, k] = 1  # the last bit in place of nothing
        factor = (a[k + 1 :, k] << bits) // a[k, k]
        a[k + 1 :, k:] -= (factor[:, None] * a[k, k:][None, :]) >> bits
        lower.append(factor)
    return lower, order


def _solved(a: np.ndarray, lower: list[np.ndarray], order: list[int], b: np.ndarray, bits: int) -> np.ndarray:
    size, b = len(a), b.copy()
    for k in range(size):
        b[[k, order[k]]] = b[[order[k], k]]
        b[k + 1 :] -= (lower[k][:, None] * b[k][None, :]) >> bits
    for k in range(size - 1, -1, -1):
        b[k] = (b[k] << bits) // a[k, k]
        b[:k] -= (a[:k, k][:, None] * b[k][None, :]) >> bits
    return b


def _orthonormal(b: np.ndarray, bits: int) -> np.ndarray:
    """Columns made orthonormal one after another, twice each for their last bits."""
    b = b.copy()
    for j in range(b.shape[1]):
        # Solutions may be huge: bring the column to the working size first.
        most = max(abs(v) for v in b[:, j])
        b[:, j] = (b[:, j] << bits) // max(1, most)
        for _ in range(2):
            for i in range(j):
                part = sum(b[:, i] * b[:, j]) >> bits
                b[:, j] -= (b[:, i] * part) >> bits
            norm = isqrt(int(sum(b[:, j] * b[:, j])))
            b[:, j] = (b[:, j] << bits) // max(1, norm)
    return b
