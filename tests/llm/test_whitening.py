"""Whitening: exact parts against plain integer versions, the whole against numpy and against its own definition."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest

from cellpath.llm import whitening as W
from cellpath.llm.queries import op11_whitening, table

VECTORS = "vec_id long, embedding array<float>, component string, v int"


def slow_polynomial(matrix):
    """Faddeev and LeVerrier's recurrence in integers; the coefficient of x ** k at k."""
    d = len(matrix)
    a = [[int(x) for x in row] for row in matrix]
    m, c = [[0] * d for _ in range(d)], [0] * d + [1]
    for k in range(1, d + 1):
        m = [[sum(a[i][t] * m[t][j] for t in range(d)) + (c[d - k + 1] if i == j else 0) for j in range(d)] for i in range(d)]
        c[d - k] = -sum(a[i][t] * m[t][i] for i in range(d) for t in range(d)) // k
    return c


def slow_scatter(x):
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    return sums, [[n * sum(r[i] * r[j] for r in x) - sums[i] * sums[j] for j in range(d)] for i in range(d)]


def _semidefinite(rng, d, rank, size):
    b = rng.integers(-size, size + 1, (d, rank)).astype(object)
    return b @ b.T


def test_polynomials(spark):
    rng = np.random.default_rng(3)
    some = [_semidefinite(rng, d, r, s) for d, r, s in ((1, 1, 9), (2, 1, 5), (5, 3, 10**6), (6, 6, 10**12), (9, 9, 3))]
    some += [np.diag(np.array(x, object)) for x in ([3, 3, 3], [0, 7, 0, 7], [1, 0, 2, 0, 0])]
    some.append(np.array([[2, 0, 1, 0], [0, 5, 0, 0], [1, 0, 3, 0], [0, 0, 0, 0]], object))
    for m in some:
        trace = sum(int(x) for x in np.diag(m))
        wanted = slow_polynomial(m)
        primes = W.primes_for(trace, len(m))
        residues = [W.polynomial_modulo(m, p) for p in primes]
        assert [W._remaindered([int(r[k]) for r in residues], primes) for k in range(len(m) + 1)] == wanted
    assert W.characteristic_polynomial(spark, some[3], sum(map(int, np.diag(some[3])))) == slow_polynomial(some[3])


def test_roots_and_eigenvectors():
    matrix = np.diag(np.array([7, 0, 7, 4, 4, 4, 10**9], object))
    polynomial = slow_polynomial(matrix)
    roots = [W.isolate(polynomial, k, 7 * 2 + 12 + 10**9) for k in range(1, 7)]
    assert [(r.multiplicity, r.larger) for r in roots] == [(1, 0), (2, 1), (2, 1), (3, 3), (3, 3), (3, 3)]
    assert [round(r.value) for r in roots] == [10**9, 7, 7, 4, 4, 4]
    for root in roots:
        vectors = W.eigenvectors(matrix, root)
        assert np.abs(vectors @ vectors.T - np.eye(root.multiplicity)).max() < 1e-14
        assert np.abs(matrix.astype(float) @ vectors.T - float(root.value) * vectors.T).max() < 1e-6
    # Two roots that doubles cannot tell apart, in a turned basis.
    turn = np.array([[3, -4], [4, 3]], object)
    near = turn @ np.diag(np.array([10**20 + 1, 10**20], object)) @ turn.T  # eigenvalues times 25
    polynomial = slow_polynomial(near)
    first, second = (W.isolate(polynomial, k, 50 * 10**20 + 25) for k in (1, 2))
    assert abs(first.value - 25 * (10**20 + 1)) < Fraction(1, 10**9) and abs(second.value - 25 * 10**20) < Fraction(1, 10**9)
    assert np.abs(W.eigenvectors(near, first)[0] - np.array([0.6, 0.8])).max() < 1e-15


@pytest.mark.parametrize("size", [5, 10**7, 10**18])
def test_sums_of_large_entries_are_exact(size):
    x = np.random.default_rng(size % 97).integers(-size, size, (50, 4))
    plain = [[int(c) for c in row] for row in x]
    assert W._products(x).tolist() == [[sum(r[i] * r[j] for r in plain) for j in range(4)] for i in range(4)]
    sums, n = np.array(slow_scatter(plain)[0], object), 50
    gap, squares = W._deviations(x, n, sums)
    exact = [sum((n * r[j] - sums[j]) ** 2 for j in range(4)) for r in plain]
    assert squares == [s if s < 1 << 63 else None for s in exact]
    values = [int(v) for v in x.ravel()] + [-(1 << 150), (1 << 150) + 3]
    parts = [c.to_pylist() for c in W._split(values)]
    assert [sum(p[i] << (40 * k) for k, p in enumerate(parts)) for i in range(len(values))] == values


def _check(found, rows, most=32):
    """Result rows against the definition, by numpy."""
    ids = [i for i, _ in rows]
    x = np.array([[int(np.floor(np.float64(np.float32(c)) * 64)) + 1_000_000 for c in v] for _, v in rows], object)
    n, d = x.shape
    sums, scatter = slow_scatter(x.tolist())
    covariance = np.array([[float(Fraction(c, n * n)) for c in r] for r in scatter])
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    size = min(most, int((values > 1e-9 * values[0]).sum()))
    assert len(found) == n * size
    deviation = {i: sum((n * a - s) ** 2 for a, s in zip(r, sums)) for i, r in zip(ids, x.tolist())}
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(r, sums)] for r in x.tolist()])
    got = np.zeros((n, size))
    place = {i: k for k, i in enumerate(ids)}
    for r in found:
        assert r.n == n and r.deviation == deviation[r.vec_id] and r.identity_error < 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(covariance), rel=1e-9)
        got[place[r.vec_id], r.component - 1] = r.whitened
    assert np.abs(got.T @ got / n - np.eye(size)).max() < 1e-9
    for c in range(size):
        if min(abs(values[c] - values[o]) for o in range(d) if o != c) > 1e-3 * values[0] / d:
            wanted = centred @ vectors[:, c] / np.sqrt(values[c])
            assert min(np.abs(got[:, c] - s * wanted).max() for s in (1, -1)) < 1e-7


def test_query_on_all_embeddings(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").collect()]
    _check(op11_whitening(spark, sf_dir).collect(), rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(8)
    good = [(i, [float(np.float32(c)) for c in rng.normal(size=3)]) for i in range(40)]
    inf, nan = float("inf"), float("nan")
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [inf, 1.0, 2.0]), (94, [nan, 1.0, 2.0]), (95, [1.0, 2.0]), (96, [-inf] * 3)]
    frame = lambda rows: spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VECTORS)
    _check(W.whiten(frame(good + bad)).collect(), good)
    _check(W.whiten(frame(good), most=2).collect(), good, most=2)
    flat = [(i, [v[0], v[1], v[1]]) for i, v in good]  # two components
    _check(W.whiten(frame(flat)).collect(), flat)
    # Repeated rows count and are returned each; a null id stays.
    again = W.whiten(frame([(1, v) for _, v in good[:5]] * 2 + [(None, good[6][1])])).collect()
    assert len(again) == 11 * 3 and {r.n for r in again} == {11} and sum(r.vec_id is None for r in again) == 3
    for rows in ([], bad[:3], [(1, [1.0, 2.0])], [(i, [0.5, 0.25]) for i in range(9)]):
        empty = W.whiten(frame(rows))
        assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    huge = W.whiten(frame([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 0.0])])).collect()
    assert len(huge) == 6 and all(r.deviation is None or r.deviation >= 0 for r in huge)
