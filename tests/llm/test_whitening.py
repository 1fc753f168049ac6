"""Whitening against numpy's dense eigenvectors and exact integers."""

import math

import numpy as np
import pytest

from rollscope.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n int, whitened double"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "clash", 2, 0.5)
                                  for i, v in rows], SCHEMA)


def grid(v):
    return [math.floor(256 * float(np.float32(c))) for c in v]


def brute(rows, components):
    """Dense covariance, eigenvectors and exact deviations of the same rows."""
    good = [(i, grid(v)) for i, v in rows]
    x = np.array(sorted({tuple(g) for _, g in good}), float)
    n = len(x)
    sums = [int(s) for s in x.sum(0)]
    c = x - x.mean(0)
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    out = {}
    for i, g in good:
        dev = sum((n * a - s) ** 2 for a, s in zip(g, sums))
        out[i] = (dev, (np.array(g) - x.mean(0)) @ u / np.sqrt(e))
    return n, e, (c * c).sum() / n, out


@pytest.mark.parametrize("d,components", [(7, 4), (3, 4), (24, 3)])
def test_equals_dense_eigenvectors(spark, d, components):
    rng = np.random.default_rng(d)
    base = rng.standard_normal((60, d)) * np.linspace(1, 2, d)
    rows = [(i, v) for i, v in enumerate(base)] + [(100 + i, base[i % 3]) for i in range(30)]  # copies fold into one
    odd = [(900, None), (901, [None] * d), (902, [float("nan")] * d), (903, [float("inf")] * d), (904, [1.0] * (d + 1)),
           (905, []), (906, [3e38] * d)]
    out, fit = whitening.whiten_vectors(frame(spark, rows + odd), components)
    n, e, trace, want = brute(rows, components)
    got = {r.vec_id: r for r in out.collect()}
    assert set(got) == set(want) and fit.n == n == 60
    k = min(d, components)
    assert np.allclose(fit.values, e, rtol=1e-12) and np.allclose(fit.explained, e / trace, rtol=1e-12)
    assert fit.identity_error < 1e-12
    w = np.array([got[i].whitened for i in want])
    ref = np.array([want[i][1] for i in want])
    signs = np.sign((w * ref).sum(0))  # either sign, the same for all rows
    assert w.shape[1] == k and np.abs(w * signs - ref).max() < 1e-9
    assert all(got[i].deviation == want[i][0] for i in want)


def test_null_ids_repeats_and_flat_tables(spark):
    rows = [(None, [1, 2]), (5, [1, 2]), (5, [1, 2])]
    out, fit = whitening.whiten_vectors(frame(spark, rows))
    assert [(r.vec_id, r.deviation, r.whitened) for r in out.orderBy("vec_id").collect()] == [
        (None, 0, []), (5, 0, []), (5, 0, [])]  # one distinct vector: no variance, no component
    assert fit.n == 1 and len(fit.values) == 0
    out, fit = whitening.whiten_vectors(frame(spark, rows + [(6, [3, 2])]))
    assert len(fit.values) == 1  # the second dimension does not vary
    assert sorted(abs(r.whitened[0]) for r in out.collect()) == pytest.approx([1, 1, 1, 1])
    empty, fit = whitening.whiten_vectors(frame(spark, rows).where("false"))
    assert empty.count() == 0 and fit.n == 0
    none, _ = whitening.whiten_vectors(frame(spark, [(1, None)]))
    assert none.count() == 0


def test_wide_integers_stay_exact(spark):
    rows = [(1, [2.0 ** 52, 1.0]), (2, [-2.0 ** 50, 2.0]), (3, [2.0 ** 20, 5.0]), (4, [0.0, 0.25])]
    out, fit = whitening.whiten_vectors(frame(spark, rows))
    assert fit.sums == [sum(grid(v)[j] for _, v in rows) for j in range(2)]
    assert all(r.deviation is None for r in out.collect())  # passes 64 bits
    x = np.array([grid(v) for _, v in rows], np.int64)
    n, sums = 10 ** 6, [int(s) for s in x.sum(0)]
    exact = [[n * int(a) - s for a, s in zip(row, sums)] for row in x]
    assert whitening.deviations(x, n, sums).tolist() == exact


def test_eigenpairs_of_close_and_repeated_values():
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.standard_normal((90, 90)))
    for values in (np.linspace(1, 1.2, 90), np.r_[np.ones(3), np.full(87, 0.5)], np.geomspace(1e-9, 1, 90), np.zeros(90)):
        a = (q * values) @ q.T
        passes = []
        e, u = whitening.leading_pairs(lambda z: passes.append(1) or a @ z, 90, 4)
        assert np.allclose(e, np.sort(values)[::-1][:4], rtol=0, atol=1e-13)
        assert np.linalg.norm(a @ u - u * e) < 1e-12 and np.allclose(u.T @ u, np.eye(4), atol=1e-12)
        assert len(passes) < 250
