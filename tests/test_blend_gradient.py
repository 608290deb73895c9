"""Continuous blend weights: gradient against all pairs, simplex, never below the start, exact AUC by SQL."""

import random

import duckdb
import numpy as np
import pytest

from riskframe.operators import blend


def _wide(spark, n=400, m=4, seed=3, parts=6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.4)
        rows.append(("oof", i, y, *[min(max(0.5 + 0.12 * (y - 0.5) * (j + 1) + rng.gauss(0, 0.15), 0.0), 1.0) for j in range(m)]))
    runs = [f"r{j}" for j in range(m)]
    rows.append(("sub", n, None, *[0.5] * m))
    return spark.createDataFrame(rows, "split string, id long, y int, " + ", ".join(f"{r} double" for r in runs)).repartition(parts), runs, rows[:-1]


def test_gradient_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(blend, "GRADIENT_BINS", 1 << 22)  # a row a range: no rounding to ranges
    wide, runs, rows = _wide(spark, 120)
    w, margin = np.array([0.1, 0.2, 0.3, 0.4]), 0.2
    x, y = np.array([r[3:] for r in rows]), np.array([r[2] for r in rows])
    p = x @ w
    loss, grad, pairs = 0.0, np.zeros(4), 0
    for i in np.flatnonzero(y == 1):
        for j in np.flatnonzero(y == 0):
            pairs += 1
            gap = max(0.0, margin - (p[i] - p[j]))
            loss += gap * gap
            grad += 2 * gap * (x[j] - x[i])
    got = blend.pair_gradient(wide, runs, w, margin, (0.0, 1.0))
    assert got[0] == pytest.approx(loss / pairs, rel=1e-5) and np.allclose(got[1], grad / pairs, rtol=1e-4, atol=1e-9)


def test_projection_is_the_nearest_point():
    rng = np.random.default_rng(1)
    for _ in range(50):
        v = rng.normal(size=5)
        w = blend.project_simplex(v)
        assert w.min() >= 0 and w.sum() == pytest.approx(1)
        for _ in range(50):
            other = rng.dirichlet(np.ones(5))
            assert np.sum((w - v) ** 2) <= np.sum((other - v) ** 2) + 1e-12


def test_never_below_the_grid_and_auc_by_sql(spark):
    wide, runs, rows = _wide(spark)
    g = blend.grid_auc(wide, runs, blend.simplex_grid(4, 4)).collect()
    best = max(g, key=lambda r: r["auc"])
    steps = blend.gradient_weights(wide, runs, tuple(best[f"w_{r}"] for r in runs), rounds=6)
    assert steps[0][2] == pytest.approx(best["auc"]) and all(a[2] < b[2] for a, b in zip(steps, steps[1:], strict=False))
    import pandas as pd

    t = pd.DataFrame([r[2:] for r in rows], columns=["y", *runs])  # noqa: F841 — read by the SQL
    for _, w, auc in steps:
        assert sum(w) == pytest.approx(1) and min(w) >= 0
        p = " + ".join(f"{v!r}::DOUBLE * {r}" for v, r in zip(w, runs, strict=True))
        told = duckdb.sql(f"WITH s AS (SELECT y, round({p}, 12) AS p FROM t) SELECT avg((a.p > b.p)::INT + 0.5 * (a.p = b.p)::INT) FROM s a, s b WHERE a.y = 1 AND b.y = 0").fetchall()[0][0]
        assert auc == pytest.approx(told, abs=1e-9)


def test_many_runs_constant_scores_and_one_class(spark):
    wide, runs, _ = _wide(spark, 200, 12)
    steps = blend.gradient_weights(wide, runs, tuple([1 / 12] * 12), rounds=3)
    assert steps[-1][2] >= steps[0][2] and len(steps[-1][1]) == 12
    flat = spark.createDataFrame([("oof", i, i % 2, 0.5, 0.5) for i in range(10)], "split string, id long, y int, a double, b double")
    assert len(blend.gradient_weights(flat, ["a", "b"], (0.5, 0.5))) == 1
    ones = spark.createDataFrame([("oof", i, 1, i / 10, 0.5) for i in range(10)], "split string, id long, y int, a double, b double")
    assert len(blend.gradient_weights(ones, ["a", "b"], (0.5, 0.5))) == 1
