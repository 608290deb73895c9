"""Queries for metrics, folds and sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskframe.operators import folds, metrics
from riskframe.plans.catalog import query
from riskframe.plans.common import rnd
from riskframe.sources.loans import load_loans
from riskframe.sources.predictions import clip_submission, score_runs


def _oof(spark, sf_dir):
    return score_runs(spark, sf_dir).filter(F.col("split") == "oof")


@query("auc")
def q_auc(spark, sf_dir):
    """M1 tie-aware AUC of every run's out-of-fold scores."""
    a = metrics.auc(_oof(spark, sf_dir), "pred", "y", by=["run"])
    return a.select("run", rnd("auc").alias("auc"), "n")


@query("model_auc")
def q_model_auc(spark, sf_dir):
    """M3/T1 runs ranked by AUC (descending, nulls last)."""
    a = metrics.auc(_oof(spark, sf_dir), "pred", "y", by=["run"])
    w = Window.orderBy(F.desc_nulls_last("auc"), "run")  # one row per run
    return a.select("run", rnd("auc").alias("auc"), F.row_number().over(w).alias("position"))


@query("best_model")
def q_best_model(spark, sf_dir):
    """T4 arg-max of AUC over the runs."""
    a = metrics.auc(_oof(spark, sf_dir), "pred", "y", by=["run"])
    return a.orderBy(F.desc_nulls_last("auc"), "run").limit(1).select("run", rnd("auc").alias("auc"))


@query("fold_auc")
def q_fold_auc(spark, sf_dir):
    """M4 AUC per run and stratified fold, plus the overall AUC (fold = -1)."""
    oof = _oof(spark, sf_dir)
    fold = folds.stratified_folds(oof.filter(F.col("run") == "open_share").select("id", "y"), "y", 5)
    j = oof.join(fold.select("id", "fold"), "id")
    per = metrics.auc(j, "pred", "y", by=["run", "fold"])
    overall = metrics.auc(oof, "pred", "y", by=["run"]).withColumn("fold", F.lit(-1))
    return per.unionByName(overall).select("run", "fold", rnd("auc").alias("auc"), "n")


@query("null_group_auc")
def q_null_group_auc(spark, sf_dir):
    """M1 per group where one group's key is null: it is a group like any other."""
    oof = _oof(spark, sf_dir).withColumn("run", F.when(F.col("run") != "hist_grade", F.col("run")))
    return metrics.auc(oof, "pred", "y", by=["run"]).select("run", rnd("auc").alias("auc"), "n")


@query("ks")
def q_ks(spark, sf_dir):
    """M5 Kolmogorov-Smirnov statistic per run."""
    return metrics.ks(_oof(spark, sf_dir), "pred", "y", by=["run"]).select("run", rnd("ks").alias("ks"))


@query("classification_report")
def q_classification_report(spark, sf_dir):
    """M5 confusion counts, accuracy, precision, recall, F1 at 0.5."""
    r = metrics.classification_report(_oof(spark, sf_dir), "pred", "y", 0.5, by=["run"])
    return r.select("run", "tp", "fp", "fn", "tn", *[rnd(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("avg_rank")
def q_avg_rank(spark, sf_dir):
    """W2 average rank of each run's scores."""
    r = metrics.avg_rank(_oof(spark, sf_dir), "pred", by=["run"], out="rank")
    return r.select("run", "id", rnd("rank").alias("rank"))


@query("minmax")
def q_minmax(spark, sf_dir):
    """W5 min-max scaling of each run's scores."""
    r = metrics.minmax_normalize(_oof(spark, sf_dir), "pred", by=["run"], out="pred_mm")
    return r.select("run", "id", rnd("pred_mm").alias("pred_mm"))


@query("class_weight")
def q_class_weight(spark, sf_dir):
    """G12 class counts over train rows and scale_pos_weight."""
    train = load_loans(spark, sf_dir).filter("is_train = 1")
    r = metrics.class_weight(train, "isDefault")
    return r.select("pos", "neg", rnd("scale_pos_weight").alias("scale_pos_weight"))


@query("submission_clip")
def q_submission_clip(spark, sf_dir):
    """S8 test predictions clipped to [0, 1] (id, isDefault per run)."""
    sub = score_runs(spark, sf_dir).filter(F.col("split") == "sub")
    sub = sub.withColumn("pred", F.col("pred") * 1.5 - 0.1)  # a raw margin-like score leaving [0, 1]
    return clip_submission(sub).select("run", "id", rnd("pred").alias("isDefault"))


@query("kfold_assign")
def q_kfold_assign(spark, sf_dir):
    """T8 md5(id) mod 5 over train rows."""
    train = load_loans(spark, sf_dir).filter("is_train = 1").select("id")
    return folds.kfold_assign(train, 5)


@query("stratified_folds")
def q_stratified_folds(spark, sf_dir):
    """T7 exactly balanced stratified 5 folds over train rows."""
    train = load_loans(spark, sf_dir).filter("is_train = 1").select("id", "isDefault")
    return folds.stratified_folds(train, "isDefault", 5)


@query("hash_sample")
def q_hash_sample(spark, sf_dir):
    """T5 deterministic sample of 1000 loans (smallest md5 of the id)."""
    return folds.hash_sample(load_loans(spark, sf_dir).select("id", "isDefault"), 1000)


@query("stratified_sample")
def q_stratified_sample(spark, sf_dir):
    """T6 a 20 % deterministic sample of every class."""
    return folds.stratified_sample(load_loans(spark, sf_dir).select("id", "isDefault"), "isDefault", 0.2)
