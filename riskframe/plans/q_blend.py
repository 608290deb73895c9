"""Queries for blending."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from riskframe.operators import blend, folds, metrics
from riskframe.plans.catalog import query
from riskframe.plans.common import materialize, rnd
from riskframe.session import checkpoint_dir
from riskframe.sources import store
from riskframe.sources.predictions import RUNS, read_predictions, score_runs, write_predictions

GRID_STEPS = 4


def aligned(spark, sf_dir):
    return materialize(blend.align(score_runs(spark, sf_dir), RUNS))


def _out(df):
    return df.select("split", "id", "y", rnd("pred").alias("pred"))


def _oof_folds(wide):
    oof = wide.filter(F.col("split") == "oof").select("id", "y")
    return folds.stratified_folds(oof, "y", 5).select("id", "fold")


def _aucs(wide):
    long = wide.filter(F.col("split") == "oof").select("y", *RUNS).unpivot(["y"], RUNS, "run", "pred")
    return {r["run"]: r["auc"] for r in metrics.auc(long, "pred", "y", by=["run"]).collect()}


@query("run_discovery")
def q_run_discovery(spark, sf_dir):
    """S9 runs written one folder each, read back; incomplete runs skipped."""
    import uuid

    path = f"{checkpoint_dir(spark).rstrip('/')}/predictions-{uuid.uuid4().hex}"
    write_predictions(score_runs(spark, sf_dir), path)
    p = read_predictions(spark, path)
    return p.groupBy("run").agg(
        F.sum(F.when(F.col("split") == "oof", 1).otherwise(0)).cast("bigint").alias("n_oof"),
        F.sum(F.when(F.col("split") == "sub", 1).otherwise(0)).cast("bigint").alias("n_sub"),
    )


@query("prediction_align")
def q_prediction_align(spark, sf_dir):
    """J1 one row per (split, id) present in every run, one column per run."""
    w = aligned(spark, sf_dir)
    return w.select("split", "id", "y", *[rnd(r).alias(r) for r in RUNS])


@query("store_align")
def q_store_align(spark, sf_dir):
    """J1/S9 the same rows from a bucketed store that holds each run as a table: joined without a shuffle."""
    import uuid

    path = f"{checkpoint_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    long = score_runs(spark, sf_dir)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for run in RUNS:
        store.write_run(long.filter(F.col("run") == run), path, run, buckets)
    w = materialize(store.align(spark, path, RUNS))
    store.detach(spark, path)
    return w.select("split", "id", "y", *[rnd(r).alias(r) for r in RUNS])


@query("blend_mean")
def q_blend_mean(spark, sf_dir):
    return _out(blend.blend_mean(aligned(spark, sf_dir), RUNS))


@query("blend_logit_mean")
def q_blend_logit_mean(spark, sf_dir):
    return _out(blend.blend_logit_mean(aligned(spark, sf_dir), RUNS))


@query("blend_rank_mean")
def q_blend_rank_mean(spark, sf_dir):
    return _out(blend.blend_rank_mean(aligned(spark, sf_dir), RUNS))


@query("spearman_matrix")
def q_spearman(spark, sf_dir):
    """G10 rank correlation of every pair of runs on the oof rows."""
    m = blend.spearman_matrix(aligned(spark, sf_dir), RUNS)
    return m.select("run_a", "run_b", rnd("rho").alias("rho"))


@query("dedupe_models")
def q_dedupe(spark, sf_dir):
    """B8 redundancy filter: per correlated group (rho >= 0.985) keep the best AUC."""
    w = aligned(spark, sf_dir)
    rho = {(r["run_a"], r["run_b"]): r["rho"] for r in blend.spearman_matrix(w, RUNS).collect()}
    kept, _ = blend.redundancy(rho, _aucs(w), RUNS)
    return spark.createDataFrame([(r, r in kept) for r in RUNS], "run string, kept boolean")


@query("blend_weight_search")
def q_weight_search(spark, sf_dir):
    """B6 best simplex weight vector (step 1/4) by oof AUC, all vectors in one job."""
    w = aligned(spark, sf_dir)
    g = blend.grid_auc(w, RUNS, blend.simplex_grid(len(RUNS), GRID_STEPS))
    best = g.orderBy(F.desc_nulls_last("auc"), "vec").limit(1)
    return best.select("vec", *[f"w_{r}" for r in RUNS], rnd("auc").alias("auc"))


@query("blend_weight_refined")
def q_weight_refined(spark, sf_dir):
    """B6 the same search carried on at steps of 1/8 and 1/16 around the best vector."""
    w = aligned(spark, sf_dir)
    best = blend.grid_auc(w, RUNS, blend.simplex_grid(len(RUNS), GRID_STEPS)).orderBy(F.desc_nulls_last("auc"), "vec").first()
    rounds = blend.refine_weights(w, RUNS, tuple(best[f"w_{r}"] for r in RUNS), start_auc=best["auc"])
    rows = [(s, *ws, a) for s, ws, a in rounds]
    out = spark.createDataFrame(rows, "steps int, " + ", ".join(f"w_{r} double" for r in RUNS) + ", auc double")
    return out.withColumn("auc", rnd("auc"))


@query("blend_weight_gradient")
def q_weight_gradient(spark, sf_dir):
    """B6 continuous weights by descent on a smooth pair loss from the best grid vector, round by round."""
    w = aligned(spark, sf_dir)
    best = blend.grid_auc(w, RUNS, blend.simplex_grid(len(RUNS), GRID_STEPS)).orderBy(F.desc_nulls_last("auc"), "vec").first()
    rows = [(k, *ws, a) for k, ws, a in blend.gradient_weights(w, RUNS, tuple(best[f"w_{r}"] for r in RUNS), start_auc=best["auc"])]
    out = spark.createDataFrame(rows, "round int, " + ", ".join(f"w_{r} double" for r in RUNS) + ", auc double")
    return out.select("round", *[rnd(f"w_{r}").alias(f"w_{r}") for r in RUNS], rnd("auc").alias("auc"))


@query("stack_ridge")
def q_stack_ridge(spark, sf_dir):
    """B5 ridge stacking (alpha 2) out-of-fold over stratified folds."""
    w = aligned(spark, sf_dir)
    return _out(blend.stack_ridge(w, RUNS, _oof_folds(w), alpha=2.0))


@query("stack_lr")
def q_stack_lr(spark, sf_dir):
    """B4 logistic-regression stacking (C = 1) out-of-fold."""
    w = aligned(spark, sf_dir)
    return _out(blend.stack_lr(w, RUNS, _oof_folds(w), C=1.0))


@query("blend_greedy")
def q_blend_greedy(spark, sf_dir):
    """B7 greedy forward selection of a mean blend."""
    w = aligned(spark, sf_dir)
    steps = blend.greedy_selection(w, RUNS, _aucs(w))
    return spark.createDataFrame([(i, r, float(a)) for i, r, a in steps], "step int, run string, auc double").withColumn("auc", rnd("auc"))


# Strategies of the summary that run at a time.
AT_ONCE = 4


def strategies(w, runs, fo, aucs, ranks=None):
    """Y3 name → blend of the runs. ``ranks``: ``ranks_long`` of the runs, if known. Weight search and greedy selection blend with what they found on the oof rows."""
    def weighted(weights):
        p = sum((F.lit(float(x)) * F.col(r) for x, r in zip(weights[1:], runs[1:])), F.lit(float(weights[0])) * F.col(runs[0]))
        return w.select("split", "id", "y", p.alias("pred"))

    def searched():
        best = blend.grid_auc(w, runs, blend.simplex_grid(len(runs), GRID_STEPS)).orderBy(F.desc_nulls_last("auc"), "vec").first()
        return weighted([best[f"w_{r}"] for r in runs])

    def greedy():
        chosen = [r for _, r, _ in blend.greedy_selection(w, runs, aucs)]
        return weighted([chosen.count(r) / len(chosen) for r in runs])

    return {
        "mean": lambda: blend.blend_mean(w, runs),
        "logit_mean": lambda: blend.blend_logit_mean(w, runs),
        "rank_mean": lambda: blend.blend_rank_mean(w, runs) if ranks is None else blend._scaled_mean(ranks.filter(F.col("run").isin(runs)), w),
        "stack_ridge": lambda: blend.stack_ridge(w, runs, fo),
        "stack_lr": lambda: blend.stack_lr(w, runs, fo),
        "weight_search": searched,
        "greedy": greedy,
    }


def summarise(spark, table: dict):
    """B9 (strategy, oof_auc, error): each strategy is run here, so one that fails
    when it is planned or when it runs scores 0.0 and says why."""
    def run(item):
        name, build = item
        try:
            return name, float(metrics.auc(build().filter(F.col("split") == "oof"), "pred", "y").first()["auc"] or 0.0), None
        except Exception as e:  # noqa: BLE001 — B9: a failed strategy scores 0
            return name, 0.0, f"{type(e).__name__}: {e}"[:200]

    # Side by side: the short last tasks of one strategy's jobs leave room for another's.
    with ThreadPoolExecutor(AT_ONCE) as pool:
        rows = [*pool.map(inheritable_thread_target(spark)(run), table.items())]
    return spark.createDataFrame(rows, "strategy string, oof_auc double, error string")


@query("blend_summary")
def q_blend_summary(spark, sf_dir):
    """B9 oof AUC of every strategy on the runs that the redundancy filter keeps."""
    w = aligned(spark, sf_dir)
    aucs = _aucs(w)
    ranks = materialize(blend.ranks_long(w, RUNS))  # for the filter and for the mean of ranks
    rho = {(r["run_a"], r["run_b"]): r["rho"] for r in blend._correlations(ranks.filter(F.col("split") == "oof"), RUNS).collect()}
    kept, _ = blend.redundancy(rho, aucs, RUNS)
    return summarise(spark, strategies(w, kept, materialize(_oof_folds(w)), aucs, ranks)).select("strategy", rnd("oof_auc").alias("oof_auc"), "error")
