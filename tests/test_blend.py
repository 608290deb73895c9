"""Blending inputs: alignment semantics (D14), run discovery, samples."""

import uuid

import pytest
from pyspark.sql import functions as F

from riskframe.operators import blend, folds
from riskframe.session import checkpoint_dir
from riskframe.sources import predictions


def _preds(spark, rows):
    return spark.createDataFrame(rows, "run string, split string, id long, y int, pred double")


def test_align_is_an_inner_join_on_id(spark):
    rows = [("a", "oof", 1, 1, 0.9), ("b", "oof", 1, 1, 0.8), ("a", "oof", 2, 0, 0.1)]
    wide = blend.align(_preds(spark, rows), ["a", "b"]).collect()
    assert [(r["id"], r["a"], r["b"]) for r in wide] == [(1, 0.9, 0.8)]
    rep = {r["split"]: (r["ids"], r["dropped"]) for r in blend.align_report(_preds(spark, rows), ["a", "b"]).collect()}
    assert rep == {"oof": (2, 1)}


def test_align_rejects_disagreeing_targets(spark):
    rows = [("a", "oof", 1, 1, 0.9), ("b", "oof", 1, 0, 0.8)]
    with pytest.raises(Exception, match="target differs"):
        blend.align(_preds(spark, rows), ["a", "b"]).collect()


def test_run_discovery_skips_incomplete_runs(spark):
    rows = [("a", "oof", 1, 1, 0.9), ("a", "sub", 2, None, 0.5), ("b", "oof", 1, 1, 0.3)]
    path = f"{checkpoint_dir(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
    predictions.write_predictions(_preds(spark, rows), path)
    got = {r["run"] for r in predictions.read_predictions(spark, path).collect()}
    assert got == {"a"}


def test_adapt_run_file_takes_last_prediction_column(spark):
    df = spark.createDataFrame([(1, 0.2, 0.7, 1)], "id long, junk double, score double, isDefault int")
    r = predictions.adapt_run_file(df, "m1", "oof").first()
    assert (r["run"], r["split"], r["id"], r["y"], r["pred"]) == ("m1", "oof", 1, 1, 0.7)


def test_samples_are_deterministic(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    a = [r["id"] for r in folds.hash_sample(df, 20).collect()]
    b = [r["id"] for r in folds.hash_sample(df.orderBy(F.desc("id")), 20).collect()]
    assert a == b and len(a) == 20
    s1 = {r["id"] for r in folds.stratified_sample(df, "y", 0.3).collect()}
    s2 = {r["id"] for r in folds.stratified_sample(df.repartition(7), "y", 0.3).collect()}
    assert s1 == s2 and 100 < len(s1) < 200


def test_align_rejects_an_id_that_a_run_holds_twice(spark):
    rows = [("a", "oof", 1, 1, 0.2), ("a", "oof", 1, 1, 0.9), ("b", "oof", 1, 1, 0.8)]
    with pytest.raises(Exception, match="repeated in a run"):
        blend.align(_preds(spark, rows), ["a", "b"]).collect()


def test_redundancy_keeps_the_best_of_each_set():
    rho = {("a", "b"): 0.99, ("b", "a"): 0.99, ("a", "c"): 0.5, ("d", "e"): 0.985, ("e", "d"): 0.985}
    aucs = {"a": 0.7, "b": 0.8, "c": None, "d": 0.6, "e": 0.6}
    assert blend.redundancy(rho, aucs, list("abcde")) == (["b", "c", "d"], ["a", "e"])
    assert blend.redundancy(rho, aucs, list("ab")) == (["a", "b"], [])


def test_simplex_points_are_the_filtered_product():
    import itertools

    for m, steps in ((1, 3), (3, 4), (5, 2)):
        want = [tuple(x / steps for x in c) for c in itertools.product(range(steps + 1), repeat=m) if sum(c) == steps]
        assert blend.simplex_grid(m, steps) == want


def _wide(spark, n=400, m=3, seed=1):
    import random

    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = rng.randint(0, 1)
        rows.append(("oof", i, y, *[min(1.0, max(0.0, 0.5 + (y - 0.5) * 0.3 * rng.random() + rng.gauss(0, 0.2 + 0.1 * j))) for j in range(m)]))
    runs = [f"r{j}" for j in range(m)]
    return spark.createDataFrame(rows, "split string, id long, y int, " + ", ".join(f"{r} double" for r in runs)), runs, rows


def _auc(rows, w):
    pos = [sum(a * b for a, b in zip(w, r[3:])) for r in rows if r[2]]
    neg = [sum(a * b for a, b in zip(w, r[3:])) for r in rows if not r[2]]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_weight_search_finds_the_best_vector_and_refines_it(spark):
    wide, runs, rows = _wide(spark)
    grid = blend.simplex_grid(3, 4)
    best = blend.grid_auc(wide, runs, grid).orderBy(F.desc("auc"), "vec").first()
    truth = [_auc(rows, w) for w in grid]
    assert abs(best["auc"] - max(truth)) < 1e-12 and abs(truth[best["vec"]] - max(truth)) < 1e-12
    (_, w8, a8), (_, w16, a16) = blend.refine_weights(wide, runs, grid[best["vec"]])
    assert best["auc"] <= a8 <= a16 and abs(a16 - _auc(rows, w16)) < 1e-9 and abs(sum(w16) - 1) < 1e-9
    assert all(abs(x * 16 - round(x * 16)) < 1e-9 for x in w16)


def test_weight_search_of_thirty_runs_ends(spark):
    wide, runs, _ = _wide(spark, n=60, m=30)
    start = tuple([1.0] + [0.0] * 29)
    (_, w, a), = blend.refine_weights(wide, runs, start, steps=(2,))
    assert a >= 0.5 and abs(sum(w) - 1) < 1e-9


def test_greedy_patience_accepts_additions_without_gain(spark, monkeypatch):
    from riskframe.operators import metrics

    seen = []

    def fake(df, *a, **k):
        seen.append(1)
        values = {1: [0.70, 0.69], 2: [0.60, 0.75], 3: [0.70, 0.70], 4: [0.70, 0.71]}[len(seen)]
        return spark.createDataFrame(list(enumerate(values)), "c int, auc double")

    monkeypatch.setattr(metrics, "auc", fake)
    wide, _, _ = _wide(spark, n=10, m=2)
    steps = blend.greedy_selection(wide, ["r0", "r1"], {"r0": 0.72, "r1": 0.65}, max_models=8, patience=2)
    # 0.70 gains nothing but is tried; 0.75 then gains, and two more without gain end it
    assert [(r, a) for _, r, a in steps] == [("r0", 0.72), ("r0", 0.70), ("r1", 0.75)] and len(seen) == 4


def test_failing_strategy_scores_zero_and_says_why(spark):
    from riskframe.plans.q_blend import summarise

    wide, runs, _ = _wide(spark, n=40)
    late = lambda: wide.select("split", "id", "y", F.raise_error(F.lit("late failure")).cast("double").alias("pred"))
    got = {r["strategy"]: r for r in summarise(spark, {"mean": lambda: blend.blend_mean(wide, runs), "late": late, "early": lambda: 1 / 0}).collect()}
    assert got["mean"]["oof_auc"] > 0.5 and got["mean"]["error"] is None
    assert got["late"]["oof_auc"] == 0.0 and "late failure" in got["late"]["error"] and "ZeroDivision" in got["early"]["error"]


def test_run_files_are_discovered(spark):
    root = f"{checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    oof = spark.createDataFrame([(1, 1, 0.8), (2, 0, 0.1)], "id long, isDefault int, oof_pred double")
    sub = spark.createDataFrame([(3, 0.4)], "id long, score double")
    for run in ("m1", "m2"):
        oof.write.parquet(f"{root}/deep/{run}/oof_x.parquet")
    sub.write.csv(f"{root}/deep/m1/submission_1.csv", header=True)
    got = predictions.discover_run_files(spark, root).collect()
    assert {(r["run"], r["split"], r["id"], r["y"], r["pred"]) for r in got} == {("m1", "oof", 1, 1, 0.8), ("m1", "oof", 2, 0, 0.1), ("m1", "sub", 3, None, 0.4)}
    with pytest.raises(FileNotFoundError):
        predictions.discover_run_files(spark, f"{root}/deep/m2")


def _scored_exactly(monkeypatch, key):
    """The points whose AUC is computed exactly, call by call."""
    from riskframe.operators import metrics

    seen, auc = [], metrics.auc

    def watched(df, *a, **k):
        seen.append(sorted(r[key] for r in df.select(key).distinct().collect()))
        return auc(df, *a, **k)

    monkeypatch.setattr(metrics, "auc", watched)
    return seen


def test_fine_bins_leave_fewer_vectors_to_score(spark, monkeypatch):
    wide, runs, rows = _wide(spark)
    grid = blend.simplex_grid(3, 4)
    monkeypatch.setattr(blend, "BOUND_BINS", 2)
    seen = _scored_exactly(monkeypatch, "vec")
    best = blend.grid_auc(wide, runs, grid).orderBy(F.desc("auc"), "vec").first()
    truth = [_auc(rows, w) for w in grid]
    assert abs(best["auc"] - max(truth)) < 1e-12 and len(seen[0]) < len(grid) // 2


def test_greedy_scores_only_candidates_in_reach(spark, monkeypatch):
    wide, runs, rows = _wide(spark)
    aucs = {r: _auc(rows, [float(q == r) for q in runs]) for r in runs}
    seen = _scored_exactly(monkeypatch, "c")
    steps = blend.greedy_selection(wide, runs, aucs)
    assert seen and all(len(c) < len(runs) for c in seen)
    pool = sorted(runs, key=lambda r: -aucs[r])
    for k in range(1, len(steps)):
        chosen = [r for _, r, _ in steps[:k]]
        of = [_auc(rows, [(chosen + [c]).count(r) / (k + 1) for r in runs]) for c in pool]
        assert abs(steps[k][2] - max(of)) < 1e-9


def test_odd_scores_do_not_break_the_bounds(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("oof", i, i % 2, s, 0.1 * i) for i, s in enumerate([nan, inf, -inf, None, 0.2, 0.9, 0.4, 0.3])]
    wide = spark.createDataFrame(rows, "split string, id long, y int, r0 double, r1 double")
    assert blend._bounds(wide, F.array("r0", "r1")) == (0.0, 0.9)
    steps = blend.greedy_selection(wide, ["r0", "r1"], {"r0": 0.75, "r1": 0.6})
    assert steps[0] == (0, "r0", 0.75)


def test_summary_ranks_once(spark, monkeypatch):
    from riskframe.plans.q_blend import strategies

    wide, runs, _ = _wide(spark, n=40)
    ranks = blend.ranks_long(wide, runs + [])
    want = {r["id"]: r["pred"] for r in blend.blend_rank_mean(wide, runs[:2]).collect()}
    monkeypatch.setattr(blend, "ranks_long", lambda *a, **k: 1 / 0)
    got = {r["id"]: r["pred"] for r in strategies(wide, runs[:2], None, {}, ranks)["rank_mean"]().collect()}
    assert got == pytest.approx(want)


def test_stacking_fits_its_folds_side_by_side(spark, monkeypatch):
    import threading

    from pyspark.ml.classification import LogisticRegression

    wide, runs, _ = _wide(spark, n=60)
    met, fit = threading.Barrier(5), LogisticRegression.fit

    def watched(self, *a, **k):
        met.wait(60)  # breaks unless five fits have begun
        return fit(self, *a, **k)

    monkeypatch.setattr(LogisticRegression, "fit", watched)
    fo = folds.stratified_folds(wide.filter("split = 'oof'").select("id", "y"), "y", 5).select("id", "fold")
    assert blend.stack_lr(wide, runs, fo).filter("split = 'oof' and pred is null").count() == 0
