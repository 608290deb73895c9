"""Components and clusters against numpy, dependencies against a count by hand."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from riskframe.operators import consistency, reduce

COLS = ["a", "b", "c", "same", "none"]
SCHEMA = "id long, a double, b double, c int, same double, none double"


def table(n=90):
    rng = np.random.default_rng(2)
    a = rng.normal(size=n)
    return [(i, float(a[i]) if i % 7 else None, float(2 * a[i] + rng.normal()), int(rng.integers(0, 5)), 0.1, None) for i in range(n)]


def scaled(rows):
    x = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows], dtype=float)
    for k in range(x.shape[1]):
        col = x[:, k]
        fill = 0.0 if np.isnan(col).all() else np.nanmean(col)
        col[np.isnan(col)] = fill
        x[:, k] = (col - fill) / col.std() if col.std() > 1e-9 else 0.0
    return x


def test_components_match_numpy(spark):
    rows = table()
    z = scaled(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    fit = reduce.fit_components(df, COLS)
    assert np.allclose(fit.gram, z.T @ z / len(z), atol=1e-9)
    assert np.allclose(fit.variance, np.sort(np.linalg.eigvalsh(z.T @ z / len(z)))[::-1], atol=1e-9)
    got = np.array([r[1:] for r in sorted(map(tuple, reduce.add_components(df, fit, 3).select("id", "n_pc1", "n_pc2", "n_pc3").collect()))])
    assert np.allclose(got, z @ fit.loadings[:, :3], atol=1e-9)
    assert np.allclose(got.T @ got / len(z), np.diag(fit.variance[:3]), atol=1e-9)  # uncorrelated
    assert all(fit.loadings[np.argmax(np.abs(fit.loadings[:, k]).round(9)), k] > 0 for k in range(5))
    plan = reduce.add_components(df, fit, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    with pytest.raises(ValueError):
        reduce.add_components(df, fit, 6)


def test_clusters_end_where_every_centre_is_its_mean(spark):
    rows = table()
    z = scaled(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    fit = reduce.fit_clusters(df, COLS, "id", 4)
    assert len(fit.centres) == 4 and 1 < fit.rounds < 100
    dist = np.linalg.norm(z[:, None, :] - fit.centres[None], axis=2)
    got = sorted(map(tuple, reduce.add_cluster(df, fit).select("id", "n_cluster", "n_cluster_dist").collect()))
    assert [g[1] for g in got] == dist.argmin(1).tolist()
    assert np.allclose([g[2] for g in got], dist.min(1))
    for k in range(4):
        assert np.allclose(z[dist.argmin(1) == k].mean(0), fit.centres[k], atol=1e-5)
    assert np.allclose(reduce.fit_clusters(df.repartition(5), COLS, "id", 4).centres, fit.centres)


def test_repeated_vectors_and_empty_tables(spark):
    df = spark.createDataFrame([(k, float(k % 2), 0.0, 0, 0.0, None) for k in range(10)], SCHEMA)
    assert len(reduce.fit_clusters(df, COLS, "id", 4).centres) == 2
    empty = spark.createDataFrame([], SCHEMA)
    fit = reduce.fit_components(empty, COLS)
    assert not fit.gram.any() and reduce.add_components(empty, fit, 2).collect() == []
    with pytest.raises(ValueError):
        reduce.fit_clusters(empty, COLS, "id", 2)


def test_dependencies_match_counts_by_hand(spark):
    rows = [("hot", "x", 1)] * 500 + [("hot", "y", 1)] * 500 + [("hot", None, 2)] * 500 + [("p", "x", 1), ("p", None, 1), (None, "x", 3), ("q", "z", 4), ("r", None, 5), ("r", None, 5)]
    df = spark.createDataFrame(rows, "k string, v string, w int")
    deps = [("k", "v"), ("k", "w"), ("w", "k")]
    want = {}
    for a, b in deps:
        held = defaultdict(Counter)
        for r in rows:
            row = dict(zip("kvw", r))
            if row[a] is not None:
                held[str(row[a])][None if row[b] is None else str(row[b])] += 1
        for key, values in held.items():
            top = min(values.items(), key=lambda t: (-t[1], t[0] is None, t[0] or ""))
            want[a, b, key] = (sum(values.values()), len(values), *top)
    got = {(r.lhs, r.rhs, r.key): (r.rows, r.n_values, r.value, r.kept) for r in consistency.key_values(df, deps).collect()}
    assert got == want
    for r in consistency.dependency_errors(df, deps).collect():
        mine = [v for k, v in want.items() if k[:2] == (r.lhs, r.rhs)]
        assert (r.rows, r.n_keys, r.n_conflicts) == (sum(m[0] for m in mine), len(mine), sum(m[1] > 1 for m in mine))
        assert abs(r.g3 - (1 - sum(m[3] for m in mine) / sum(m[0] for m in mine))) < 1e-12
    bad = {(r.lhs, r.rhs, r.key) for r in consistency.conflicts(df, deps).collect()}
    assert bad == {k for k, v in want.items() if v[1] > 1}
    assert consistency.dependency_errors(df.limit(0), deps).collect() == []
