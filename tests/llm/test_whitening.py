"""Whitening against exact sums and a library's eigenvectors."""

import math
from fractions import Fraction

import numpy as np
import pytest

from matchweave.llm import whitening


def test_factor_and_rotations():
    r = np.random.default_rng(1)
    for d, rank in ((1, 1), (2, 2), (7, 7), (33, 33), (20, 5), (6, 0)):
        a = r.normal(size=(d, rank)) * 10.0 ** r.uniform(-3, 3, rank)
        v = a @ a.T
        factor = whitening.pivoted_cholesky(v)
        assert factor.shape == (d, rank) and np.allclose(factor @ factor.T, v, rtol=1e-9, atol=1e-12 * (abs(v).max() if rank else 1))
        value, vector = whitening.jacobi(factor)
        assert np.allclose(vector.T @ vector, np.eye(rank), atol=1e-12) and (np.diff(value) <= 0).all()
        assert np.allclose(value, np.linalg.eigvalsh(v)[::-1][:rank], rtol=1e-8, atol=1e-10 * (value.max() if rank else 1))


def test_small_eigenvalues_keep_their_digits():
    """Rotating the factor keeps eigenvalues that rotating the matrix itself would lose in rounding."""
    scale = np.array([1e8, 1.0, 1e-6])
    factor = np.diag(scale) @ np.array([[1, 0, 0], [0.5, 1, 0], [0.25, 0.5, 1.0]])
    value, _ = whitening.jacobi(factor)
    assert value.prod() == pytest.approx(float(np.prod(scale**2)), rel=1e-12)


def rows_of(r, n=300, d=20):
    a = r.normal(size=(d, d)) @ np.diag(1.5 ** -np.arange(d))
    return [(i, [float(x) for x in v]) for i, v in enumerate(r.normal(size=(n, d)) @ a)]


def test_against_a_library(spark):
    rows = rows_of(np.random.default_rng(3))
    hot = rows[5][1]
    rows += [(1000 + i, hot) for i in range(200)]
    rows += [(2000, None), (2001, [float("nan")] * 20), (2002, [float("inf")] + [0.0] * 19), (2003, [None] + [0.0] * 19), (None, rows[7][1]), (2**60 + 1, rows[8][1]), (2**60 + 1, rows[8][1]), (-4, rows[9][1])]
    table = spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id long, embedding array<double>, x string").repartition(4)
    got = whitening.whiten(table).collect()
    valid = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    assert len(got) == 16 * len(valid)
    fixed = lambda v: tuple(math.floor(64 * x) + 1_000_000 for x in v)
    listed = sorted({fixed(v) for _, v in valid})
    n, total = len(listed), [sum(c) for c in zip(*listed)]
    y = np.array([[float(x - Fraction(s, n)) for x, s in zip(v, total)] for v in listed])
    cov = y.T @ y / n
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1], vector[:, ::-1]
    sign = {}
    by_id = {}
    for i, v in valid:
        by_id.setdefault(i, fixed(v))
    assert {r.vec_id for r in got} == set(by_id)
    for r in got:
        x, k = by_id[r.vec_id], r.component - 1
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, total))
        assert r.explained == pytest.approx(value[k] / np.trace(cov), rel=1e-9) and r.identity_error <= 1e-9
        want = np.array([float(a - Fraction(s, n)) for a, s in zip(x, total)]) @ vector[:, k] / math.sqrt(value[k])
        if abs(want) > 1e-3:
            sign.setdefault(k, math.copysign(1, r.whitened * want))
            assert r.whitened * sign[k] == pytest.approx(want, rel=1e-6)


def test_ranks_lengths_and_large_entries(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(10)]  # rank 1
    rows += [(100 + i, [float(i % 3), float(i % 2)]) for i in range(6)]  # another length
    rows += [(200, [1.0]), (201, [1.0]), (202, [])]  # all equal: no component
    rows += [(300 + i, [2.0**50 * i, 1.0 * i, 7.0 * (i % 3), 1.0]) for i in range(5)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    of = lambda lo, hi: [r for r in got if lo <= r.vec_id < hi]
    assert len(of(0, 100)) == 10 and {r.component for r in of(0, 100)} == {1} and {r.explained for r in of(0, 100)} == {1.0}
    assert len(of(100, 200)) == 12 and {r.n for r in of(100, 200)} == {6} and not of(200, 300)
    assert all(r.deviation is None for r in of(300, 400) if r.vec_id != 302) and of(300, 400)
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    with pytest.raises(Exception, match="an entry is beyond"):
        whitening.whiten(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>")).count()
