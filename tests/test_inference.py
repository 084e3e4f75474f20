"""The Boltzmann machine and densities against plain loops."""

import random

import numpy as np
from pyspark.sql import functions as F
from tesserine.operators import inference


def test_boltzmann_machine(spark):
    rng = np.random.default_rng(2)
    data = (rng.random((60, 6)) < np.where(np.arange(60)[:, None] % 2, [0.9, 0.9, 0.9, 0.1, 0.1, 0.1], [0.1, 0.1, 0.1, 0.9, 0.9, 0.9])).astype(float)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)] + [(None, [1.0] * 6), (70, [1.0] * 5), (71, [None] * 6), (72, None)], "k long, p array<double>")
    dealt = {r["k"]: r["b"] for r in rows.filter("k < 60").select("k", F.pmod(F.xxhash64("k"), F.lit(3)).alias("b")).collect()}
    h, sigmoid = 4, lambda x: 1 / (1 + np.exp(-x))
    w, vb, hb = np.random.default_rng(7).normal(size=(6, h)) * 0.1, np.zeros(6), np.zeros(h)
    dw, dv, dh, errors = np.zeros_like(w), np.zeros(6), np.zeros(h), []
    for epoch in range(8):
        errors.append(0.0)
        for b in range(3):
            keys = np.array([k for k in dealt if dealt[k] == b])
            x = data[keys]
            up = sigmoid(x @ w + hb)
            down = sigmoid((up > inference.uniforms(keys, epoch * 3 + b, h)) @ w.T + vb)
            again = sigmoid(down @ w + hb)
            momentum = 0.9 if epoch > 5 else 0.5
            errors[-1] += ((x - down) ** 2).sum()
            dw = momentum * dw + 0.1 * ((x.T @ up - down.T @ again) / len(x) - 0.0002 * w)
            dv = momentum * dv + 0.1 * (x - down).mean(axis=0)
            dh = momentum * dh + 0.1 * (up - again).mean(axis=0)
            w, vb, hb = w + dw, vb + dv, hb + dh
    got = inference.boltzmann_machine(rows, "k", "p", h, 3, epochs=8)
    for mine, want in zip(got, (w, vb, hb, errors)):
        assert np.allclose(mine, want, atol=1e-9)
    assert errors[-1] < errors[0]
    assert inference.boltzmann_machine(rows.limit(0), "k", "p", h, 3)[3] == []


def test_local_density(spark):
    random.seed(4)
    points = [(i, [round(random.uniform(-5, 5), 1), round(random.uniform(-5, 5), 1), 1.0]) for i in range(150)] + [(200 + i, [0.0, 0.0, 1.0]) for i in range(20)]
    want = {i: sum(sum(abs(x - y) for x, y in zip(p, q)) < 2.0 for _, q in points) for i, p in points}
    rows = spark.createDataFrame([*points, (900, None), (901, [None, 1.0, 1.0])], "k int, p array<double>")
    assert {r["key"]: r["n"] for r in inference.local_density(rows, "k", "p", 2.0).collect()} == want


def test_local_density_at_rounded_bounds(spark):
    """Many points at the very bound, in few groups and in none, with cells dealt over tasks: all as in plain loops."""
    random.seed(5)
    for dims, values in ((1, 40), (2, 40), (2, 3), (3, 2), (5, 4)):
        points = [(i, [random.randrange(values * 8) / 10, *(random.randrange(values) / 10 for _ in range(dims - 1))]) for i in range(300)]
        want = {}
        for i, p in points:
            want[i] = 0
            for _, q in points:
                apart = 0.0
                for x, y in zip(p, q):
                    apart += abs(x - y)
                want[i] += apart < 0.7
        rows = spark.createDataFrame(points, "k int, p array<double>")
        assert {r["key"]: r["n"] for r in inference.local_density(rows, "k", "p", 0.7, most=20).collect()} == want


def test_near_is_not_quadratic():
    """100,000 points beside 100,000 others of 25 kinds, in seconds and exact against all pairs for some of them."""
    rng = np.random.default_rng(3)
    own = np.stack([rng.integers(-99999, 999999, 100_000) / 10000, rng.integers(0, 25, 100_000).astype(float)], axis=1)
    others = np.unique(np.stack([rng.integers(-99999, 999999, 100_000) / 10000, rng.integers(0, 25, 100_000).astype(float)], axis=1), axis=0)
    times = rng.integers(1, 4, len(others))
    got = inference.near(own, others, times, 5.0)
    for i in range(0, 100_000, 5000):
        assert got[i] == times[np.abs(own[i, 0] - others[:, 0]) + np.abs(own[i, 1] - others[:, 1]) < 5.0].sum()
