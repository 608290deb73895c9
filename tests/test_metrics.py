"""Rank metrics against brute force; folds and samples."""

import random

from pyspark.sql import functions as F

from riskframe.operators import blend, folds, metrics


def _pairwise_auc(ys, ss):
    pos = [s for y, s in zip(ys, ss) if y == 1]
    neg = [s for y, s in zip(ys, ss) if y == 0]
    if not pos or not neg:
        return None
    tot = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_matches_pairwise_for_any_number_of_ranges(spark):
    rnd = random.Random(3)
    rows = [(g, rnd.randint(0, 1), round(rnd.random(), 2)) for g in ("a", "b") for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, y int, s double")
    for parts in (None, 2, 7, 2000):
        got = {r["g"]: r["auc"] for r in metrics.auc(df, "s", "y", by=["g"], parts=parts).collect()}
        for g in ("a", "b"):
            ys = [y for gg, y, s in rows if gg == g]
            ss = [s for gg, y, s in rows if gg == g]
            assert abs(got[g] - _pairwise_auc(ys, ss)) < 1e-12


def test_auc_edge_cases(spark):
    one = spark.createDataFrame([(1, 0.3), (1, 0.5)], "y int, s double")
    assert metrics.auc(one, "s", "y").first()["auc"] is None
    ties = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.5)], "y int, s double")
    assert metrics.auc(ties, "s", "y").first()["auc"] == 0.5


def test_average_rank(spark):
    df = spark.createDataFrame([(0, 1.0), (1, None), (2, 1.0), (3, 2.0)], "i int, s double")
    got = {r["i"]: r["rank"] for r in metrics.avg_rank(df, "s").collect()}
    assert got == {0: 1.5, 1: None, 2: 1.5, 3: 3.0}


def test_ks_matches_brute_force(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 1)) for _ in range(200)]
    df = spark.createDataFrame(rows, "y int, s double")
    P = sum(y for y, _ in rows)
    N = len(rows) - P
    best = max(sum(y for y, s in rows if s >= t) / P - sum(1 - y for y, s in rows if s >= t) / N
               for t in {s for _, s in rows})
    assert abs(metrics.ks(df, "s", "y").first()["ks"] - best) < 1e-12


def test_stratified_folds_balanced_and_stable(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1003)], "id long, y int")
    f = folds.stratified_folds(df, "y", 5)
    counts = {(r["y"], r["fold"]): r["n"] for r in f.groupBy("y", "fold").agg(F.count("*").alias("n")).collect()}
    for y in (0, 1):
        sizes = [counts.get((y, k), 0) for k in range(5)]
        assert max(sizes) - min(sizes) <= 1
    again = folds.stratified_folds(df.orderBy(F.desc("id")), "y", 5)
    a = {r["id"]: r["fold"] for r in f.collect()}
    b = {r["id"]: r["fold"] for r in again.collect()}
    assert a == b


def test_weight_grid_sums_to_one():
    for w in blend.simplex_grid(3, 4):
        assert abs(sum(w) - 1.0) < 1e-12
    assert len(blend.simplex_grid(5, 4)) == 70


def test_ridge_stacking_matches_numpy(spark):
    import numpy as np

    rnd = random.Random(11)
    rows = [("oof", i, rnd.randint(0, 1), rnd.random(), rnd.random()) for i in range(200)]
    rows += [("sub", 1000 + i, None, rnd.random(), rnd.random()) for i in range(20)]
    wide = spark.createDataFrame(rows, "split string, id long, y int, a double, b double")
    fo = spark.createDataFrame([(i, i % 5) for i in range(200)], "id long, fold int")
    got = {r["id"]: r["pred"] for r in blend.stack_ridge(wide, ["a", "b"], fo, alpha=2.0).collect()}
    X = np.array([[r[3], r[4]] for r in rows[:200]])
    y = np.array([r[2] for r in rows[:200]], dtype=float)
    for f in range(5):
        tr = np.array([i % 5 != f for i in range(200)])
        xm, ym = X[tr].mean(0), y[tr].mean()
        Xc = X[tr] - xm
        w = np.linalg.solve(Xc.T @ Xc + 2.0 * np.eye(2), Xc.T @ (y[tr] - ym))
        for i in np.where(~tr)[0]:
            assert abs(got[i] - (X[i] @ w + ym - xm @ w)) < 1e-9


def test_distributed_quantiles_equal_spark_percentile(spark):
    from riskframe.operators import stats

    rnd = random.Random(9)
    rows = [(float(rnd.randint(0, 30)), rnd.random() if rnd.random() > 0.1 else None) for _ in range(500)]
    df = spark.createDataFrame(rows, "a double, b double")
    probs = [0.0, 0.005, 0.25, 0.5, 0.9, 0.995, 1.0]
    got = stats.quantiles(df, ["a", "b"], probs)
    ref = df.agg(F.percentile("a", probs).alias("a"), F.percentile("b", probs).alias("b")).first()
    for c in ("a", "b"):
        for g, e in zip(got[c], ref[c]):
            assert abs(g - e) < 1e-12


def test_quantiles_are_the_same_for_any_number_of_ranges(spark):
    from riskframe.operators import stats

    rnd = random.Random(13)
    rows = [(float(rnd.randint(0, 40)), rnd.gauss(0, 1) if rnd.random() > 0.1 else None) for _ in range(700)]
    rows += [(float("nan"), float("inf")), (float("-inf"), None)]
    df = spark.createDataFrame(rows, "a double, b double")
    probs = [0.0, 0.005, 0.05, 0.5, 0.95, 0.995, 1.0]
    clean = stats.inf_to_null(df)
    ref = clean.agg(F.percentile("a", probs).alias("a"), F.percentile("b", probs).alias("b")).first()
    for parts in (None, 2, 2000):
        got = stats.quantiles(df, ["a", "b"], probs, parts=parts)
        for c in ("a", "b"):
            for g, e in zip(got[c], ref[c]):
                assert abs(g - e) < 1e-12


def test_null_groups_and_nan_labels(spark):
    nan = float("nan")
    rows = [(None, 1, 0.9), (None, 0, 0.1), ("a", 1, 0.2), ("a", 0, 0.4), ("a", 1, nan), (None, None, 0.5)]
    df = spark.createDataFrame(rows, "g string, y int, s double")
    got = {r["g"]: (r["auc"], r["n"]) for r in metrics.auc(df, "s", "y", by=["g"]).collect()}
    assert got == {None: (1.0, 2), "a": (0.0, 2)}
    assert {r["g"]: r["ks"] for r in metrics.ks(df, "s", "y", by=["g"]).collect()}[None] == 1.0
    assert metrics.avg_rank(df, "s", by=["g"]).filter("g is null and rank is null").count() == 0
