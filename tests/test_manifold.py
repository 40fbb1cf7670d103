"""Fuzzy graphs and layouts: scales by the definition, neighbours that stay neighbours, reruns that agree."""

import numpy as np
import pytest
from test_neighbours import vectors_of

from flockscope.operators import manifold


def trustworthiness(x, y, k):
    """1 for layouts whose k nearest are all among the k nearest before; what intrudes counts by its rank."""
    n = len(x)
    dx, dy = (np.linalg.norm(z[:, None] - z[None], axis=2) for z in (x, y))
    np.fill_diagonal(dx, -1)
    np.fill_diagonal(dy, np.inf)
    rank = np.argsort(np.argsort(dx, axis=1), axis=1)
    near = np.argsort(dy, axis=1)[:, :k]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * sum(max(rank[i, j] - k, 0) for i in range(n) for j in near[i])


def test_scales():
    d = np.sort(np.random.default_rng(0).uniform(0.1, 2, (30, 15)), axis=1)
    p = manifold.scales(d)
    assert p[:, 0] == pytest.approx(1) and p.sum(1) == pytest.approx(np.log2(15), abs=1e-3) and (np.diff(p, axis=1) <= 0).all()
    assert np.isfinite(manifold.scales(np.zeros((2, 15)))).all()


def test_curve():
    a, b = manifold.curve(0.1)
    assert a == pytest.approx(1.577, abs=0.02) and b == pytest.approx(0.895, abs=0.01)


def test_fuzzy_graph(spark):
    near = spark.createDataFrame([(0, 1, 0.1), (0, 2, 0.5), (1, 0, 0.1), (1, 2, 0.2), (2, 1, 0.2), (2, 0, 0.5)], "id long, n long, d double")
    p = {(i, n): w for i, row in ((0, [0.1, 0.5]), (1, [0.1, 0.2]), (2, [0.2, 0.5])) for n, w in zip({0: (1, 2), 1: (0, 2), 2: (1, 0)}[i], manifold.scales(np.array([row]))[0], strict=True)}
    got = {(r.a, r.b): r.p for r in manifold.fuzzy_graph(near).collect()}
    assert got == pytest.approx({(a, b): p[a, b] + p[b, a] - p[a, b] * p[b, a] for a, b in ((0, 1), (0, 2), (1, 2))})


def test_layout_keeps_neighbours(spark):
    """Five clusters on curved sheets in twenty dimensions, laid out in three."""
    rng = np.random.default_rng(3)
    sheets = []
    for _ in range(5):
        u = rng.uniform(-1, 1, (90, 2))
        flat = np.stack([u[:, 0], u[:, 1], np.sin(3 * u[:, 0]), u[:, 0] * u[:, 1]], 1)
        sheets.append(flat @ rng.normal(size=(4, 20)) + rng.normal(0, 4, 20) + rng.normal(0, 0.02, (90, 20)))
    x = np.concatenate(sheets)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    v = vectors_of(spark, x)
    run = lambda: np.array([r.v for r in sorted(manifold.reduced_manifold(v, 3, rounds=5, chunk=150).collect(), key=lambda r: r.id)])
    y = run()
    score = trustworthiness(unit, y, 15)
    assert y.shape == (450, 3) and np.isfinite(y).all() and score >= 0.9, score


def test_few_vectors_stay_as_they_are(spark):
    v = vectors_of(spark, np.eye(4))
    assert sorted(tuple(r.v) for r in manifold.reduced_manifold(v).collect()) == sorted(map(tuple, np.eye(4).tolist()))
