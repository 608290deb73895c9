"""Queries for EDA and result reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import folds, metrics, report
from riskframe.plans.catalog import query
from riskframe.plans.common import materialize, rnd
from riskframe.sources.loans import load_loans
from riskframe.sources.predictions import score_runs


def _train(spark, sf_dir):
    return load_loans(spark, sf_dir).filter("is_train = 1")


@query("rate_by_grade")
def q_rate_by_grade(spark, sf_dir):
    """X2/G2 loans and default rate per grade (train rows)."""
    r = report.rate_by(_train(spark, sf_dir), "grade", "isDefault")
    return r.select("grade", "n", rnd("default_rate").alias("default_rate"))


@query("count_by_grade")
def q_count_by_grade(spark, sf_dir):
    """G3 value counts of the grade over all loans."""
    return load_loans(spark, sf_dir).groupBy("grade").agg(F.count(F.lit(1)).alias("n"))


@query("histogram")
def q_histogram(spark, sf_dir):
    """X3 50-bin histogram of log1p(annual income) (finite values only)."""
    h = report.histogram(load_loans(spark, sf_dir), "annualIncome", 50, log=True)
    return h.select("bin", rnd("lo").alias("lo"), rnd("hi").alias("hi"), "n")


def results_table(spark, sf_dir):
    """Results of every run per fold: (model, family, version, auc), version = fold."""
    oof = score_runs(spark, sf_dir).filter(F.col("split") == "oof")
    fo = folds.stratified_folds(oof.filter(F.col("run") == "open_share").select("id", "y"), "y", 5)
    a = metrics.auc(oof.join(fo.select("id", "fold"), "id"), "pred", "y", by=["run", "fold"])
    return materialize(a.select(
        F.col("run").alias("model"), F.split("run", "_").getItem(0).alias("family"),
        F.col("fold").alias("version"), "auc"))


@query("improvement_vs_baseline")
def q_improvement(spark, sf_dir):
    r = report.improvement_vs_baseline(results_table(spark, sf_dir))
    return r.select("model", "version", rnd("auc").alias("auc"), rnd("improvement_bp").alias("improvement_bp"))


@query("fe_delta")
def q_fe_delta(spark, sf_dir):
    r = report.version_delta(results_table(spark, sf_dir), 0)
    return r.select("model", "version", rnd("auc").alias("auc"), rnd("delta").alias("delta"))


@query("best_results")
def q_best_results(spark, sf_dir):
    r = report.best_results(results_table(spark, sf_dir))
    return r.select("model", "family", "best_version", rnd("auc").alias("auc"), rnd("vs_reference").alias("vs_reference"))


@query("result_averages")
def q_result_averages(spark, sf_dir):
    r = report.result_averages(results_table(spark, sf_dir))
    return r.select("by", "value", rnd("avg_auc").alias("avg_auc"))
