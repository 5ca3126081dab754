"""Whitening against NumPy's eigendecomposition of the centred covariance, exact deviations, multiple roots and odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meltframe.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>"


def integer_rows(rows):
    return {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for i, v in rows}


def check(spark, rows, usable, most=16):
    found = W.whiten(spark.createDataFrame(rows, SCHEMA).withColumns({"x": F.lit(1), "n": F.lit("y"), "label": F.lit(0)}), most).collect()
    x = integer_rows(usable)
    fit = np.array(sorted(set(map(tuple, x.values()))), dtype=np.float64)
    n, d = fit.shape
    centred = fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, int((values > 1e-9 * max(values[0], 1e-9)).sum()))
    assert len(found) == len(usable) * k
    sums = [int(s) for s in fit.sum(axis=0)]
    by_id = {}
    for r in found:
        by_id.setdefault(r.vec_id, {})[r.component] = r
        assert r.n == n and r.identity_error <= 1e-9
        assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(x[r.vec_id], sums))
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-10
    projected = {c + 1: (np.array([x[i] for i, _ in usable]) - fit.mean(axis=0)) @ vectors[:, c] / math.sqrt(values[c]) for c in range(k)}
    return by_id, projected, [i for i, _ in usable], values


def test_equals_eigendecomposition(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(24, 24)) * np.linspace(2, 0.2, 24)
    rows = [(i, [float(v) for v in np.float32(rng.normal(size=24) @ mix / 8)]) for i in range(300)]
    odd = [(900, None), (901, [1.0, None] + [0.0] * 22), (902, [float("nan")] + [0.0] * 23), (903, [float("inf")] + [0.0] * 23), (904, []), (905, [1.0, 2.0])]
    copies = [(1_000 + i, rows[0][1]) for i in range(150)]
    usable = rows + copies
    by_id, projected, ids, _ = check(spark, usable + odd, usable)
    for c, want in projected.items():
        got = np.array([by_id[i][c].whitened for i in ids])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-7


def test_multiple_roots_and_zero_variance(spark):
    """Two pairs of equal eigenvalues and a constant dimension: an orthonormal basis of each space, nothing for variance zero."""
    rows = []
    for i, (a, b) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)]):
        for j, (c, e) in enumerate([(2, 0), (-2, 0), (0, 2), (0, -2)]):
            rows.append((i * 4 + j, [float(a), float(b), float(c), float(e), 5.0]))
    by_id, _, ids, _ = check(spark, rows, rows)
    w = np.array([[by_id[i][c].whitened for c in range(1, 5)] for i in ids])
    assert np.abs(w.T @ w / len(w) - np.eye(4)).max() < 1e-12


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(v) for v in (i * 1_000_003 % 977 * 1e3, i * 7.25, -i * 3e4, 1.0)]) for i in range(40)]
    check(spark, rows, rows, most=3)


def test_no_rows(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [3.0])]):
        found = W.whiten(spark.createDataFrame(rows, SCHEMA))
        assert found.collect() == [] and "identity_error" in found.columns


def test_polynomial_and_roots(spark):
    rng = random.Random(4)
    b = [[rng.randint(-9, 9) for _ in range(7)] for _ in range(7)]
    s = [[sum(b[i][k] * b[j][k] for k in range(7)) for j in range(7)] for i in range(7)]
    c = W.characteristic(spark, s)
    assert np.allclose(np.array(c[::-1], float), np.poly(np.array(s, float)), rtol=1e-8)
    roots = W.RealRoots(c).largest(7, sum(s[i][i] for i in range(7)))
    assert np.allclose([float(r.value) for r in roots], np.linalg.eigvalsh(np.array(s, float))[::-1], rtol=1e-9)
    # (t - 3)^2 (t - 1): a double root on an integer
    triple = W.RealRoots([-9, 15, -7, 1]).largest(3, 7)
    assert [(round(float(r.value), 12), r.count) for r in triple] == [(3.0, 2), (1.0, 1)]


@pytest.mark.parametrize("count", [1, 2])
def test_null_space(count):
    s = [[2, 0, 0], [0, 2, 0], [0, 0, 5]]
    found = W.null_space(s, W.Decimal(5 if count == 1 else 2), count)
    assert np.allclose(np.array(found) @ np.array(found).T, np.eye(count))
    assert np.allclose(np.array(s) @ np.array(found).T, (5 if count == 1 else 2) * np.array(found).T)
