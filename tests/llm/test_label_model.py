"""The label model and the classifier of operator 3 against plain versions, term by term."""

import math
import random

import numpy as np
import pytest

from flockscope.llm import toxicity

V = toxicity.VOTERS


def drawn(seed, n=4000, prior=0.2):
    """Votes of two classes with known rates; the last two voters repeat the first."""
    rng = random.Random(seed)
    rates = [[rng.uniform(0.02, 0.2) for _ in range(V)], [rng.uniform(0.4, 0.9) for _ in range(V)]]
    rows = []
    for _ in range(n):
        y = rng.random() < prior
        bits = [rng.random() < rates[y][j] for j in range(V)]
        bits[-1] = bits[-2] = bits[0]
        rows.append((sum(b << j for j, b in enumerate(bits)), int(y)))
    return rows, rates


def plain_em(patterns, weight, start, prior, rounds):
    """The same steps with loops and lists."""
    total = sum(weight)
    weight = [w / total for w in weight]
    votes = [[(p >> j) & 1 for j in range(V)] for p in patterns]
    rates = [[min(max(x, 1e-3), 1 - 1e-3) for x in row] for row in start]
    share = [1.0] * V

    def posterior():
        out = []
        for v in votes:
            z = math.log(prior / (1 - prior))
            for j in range(V):
                z += share[j] * (math.log(rates[1][j] / rates[0][j]) if v[j] else math.log((1 - rates[1][j]) / (1 - rates[0][j])))
            out.append(1 / (1 + math.exp(-min(max(z, -30), 30))))
        return out

    for _ in range(rounds):
        p = posterior()
        q = [[1 - x for x in p], p]
        mass = [sum(w * x for w, x in zip(weight, q[y], strict=True)) for y in (0, 1)]
        rates = [[min(max(sum(w * x * v[j] for w, x, v in zip(weight, q[y], votes, strict=True)) / max(mass[y], 1e-12), 1e-4), 1 - 1e-4) for j in range(V)] for y in (0, 1)]
        prior = min(max(mass[1], 1e-3), 0.5)
        cov = [[sum(w * q[y][n] * (votes[n][i] - rates[y][i]) * (votes[n][j] - rates[y][j]) for y in (0, 1) for n, w in enumerate(weight)) for j in range(V)] for i in range(V)]
        sd = [math.sqrt(max(cov[i][i], 1e-9)) for i in range(V)]
        share = [1 / max(1.0, sum(max(min(cov[i][j] / sd[i] / sd[j], 1), 0) for j in range(V))) for i in range(V)]
    return rates, prior, share, posterior()


def test_label_model_against_a_plain_one():
    rows, rates = drawn(1, 300)
    patterns = sorted({p for p, _ in rows})
    weight = [sum(q == p for q, _ in rows) for p in patterns]
    start = [[0.1] * V, [0.6] * V]
    model = toxicity.LabelModel(np.array(patterns, np.int64), np.array(weight, float), np.array(start), 0.3, rounds=3)
    want, prior, share, posterior = plain_em(patterns, weight, start, 0.3, 3)
    assert model.rates == pytest.approx(np.array(want)) and model.prior == pytest.approx(prior) and model.share == pytest.approx(np.array(share))
    assert model.posterior(np.array(patterns, np.int64)) == pytest.approx(np.array(posterior))


def test_label_model_finds_the_rates():
    """Without labels the classes, their rates and the repeated voter come out."""
    rows, rates = drawn(2, 20_000)
    patterns, weight = np.unique([p for p, _ in rows], return_counts=True)
    model = toxicity.LabelModel(patterns.astype(np.int64), weight.astype(float), np.array([[0.1] * V, [0.6] * V]), 0.3)
    free = range(1, V - 2)  # whose votes are drawn by themselves
    assert model.prior == pytest.approx(0.2, abs=0.02)
    assert all(abs(model.rates[y][j] - rates[y][j]) < 0.03 for y in (0, 1) for j in free)
    assert model.share[0] < 0.45 and model.share[1:-2].min() > 0.7 and model.correlation[0, -1] > 0.9
    p = model.posterior(np.array([p for p, _ in rows], np.int64))
    assert np.mean((p >= 0.5) == np.array([y for _, y in rows])) > 0.98


def test_classifier_reaches_the_least_loss():
    """Gradient descent ends where Newton's method does, for soft labels and sparse rows."""
    rng = np.random.default_rng(3)
    width, n, l2 = 5, 400, 1e-3
    x = rng.uniform(0, 2, (n, width)) * (rng.random((n, width)) < 0.6)
    x[:, -1] += 0.1  # every row has its density
    target = 1 / (1 + np.exp(-(x @ np.array([1.5, -1.0, 0.5, 0.0, 2.0]) - 1.5 + rng.normal(0, 0.5, n))))
    rows = [([int(i) for i in np.flatnonzero(r)], [float(v) for v in r[r > 0]]) for r in x]
    w, b = toxicity.fit_logistic(rows, target, width, l2, rounds=3000)
    a, penalty = np.c_[x, np.ones(n)], l2 / width * np.diag([1.0] * width + [0.0])
    u = np.zeros(width + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-a @ u))
        u -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) / n + penalty, a.T @ (p - target) / n + penalty @ u)
    assert np.append(w, b) == pytest.approx(u, abs=2e-2)
