"""Report tables: the aggregates behind the
charts, not the drawing. Results tables have columns (model, family,
version, auc)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rate_by(df: DataFrame, key: str, target: str) -> DataFrame:
    """X2/G2/G3 rows and target rate per key value."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(target).cast("double")).alias("default_rate"))


def histogram(df: DataFrame, col: str, bins: int = 50, log: bool = False) -> DataFrame:
    """X3 equal-width histogram of the finite values (optionally of log1p of
    the clipped value): one min/max job, then one grouped count."""
    x = F.col(col).cast("double")
    if log:
        x = F.log1p(F.greatest(x, F.lit(0.0)))
    v = df.select(x.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < F.lit(math.inf)))
    r = v.agg(F.min("v"), F.max("v")).first()
    lo, hi = r[0], r[1]
    if lo is None:
        return v.limit(0).select(F.lit(0).alias("bin"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"),
                                 F.lit(0).cast("bigint").alias("n"))
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    return v.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n")).select(
        "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"), "n")


def improvement_vs_baseline(results: DataFrame) -> DataFrame:
    """V1 each result's gain over the weakest result, in 1/10 000 AUC."""
    mn = results.agg(F.min("auc")).first()[0]
    return results.withColumn("improvement_bp", (F.col("auc") - F.lit(mn)) * 10000)


def version_delta(results: DataFrame, base_version) -> DataFrame:
    """V2 per model: AUC of every version minus the base version's AUC."""
    base = results.filter(F.col("version") == base_version).select("model", F.col("auc").alias("__base"))
    return results.join(base, "model", "left").select(
        "model", "version", "auc", (F.col("auc") - F.col("__base")).alias("delta"))


def best_results(results: DataFrame, reference: float = 0.71) -> DataFrame:
    """V3 best AUC per model and its margin over a fixed reference score."""
    w = Window.partitionBy("model").orderBy(F.desc("auc"), "version")  # rows per model = versions
    best = results.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
    return best.select("model", "family", F.col("version").alias("best_version"), "auc",
                       (F.col("auc") - F.lit(reference)).alias("vs_reference"))


def result_averages(results: DataFrame) -> DataFrame:
    """V4 average AUC by family and by version (one grouping-sets job)."""
    g = results.groupBy("family", "version").agg(F.avg("auc").alias("auc"), F.count(F.lit(1)).alias("n"))
    by_family = g.groupBy("family").agg((F.sum(F.col("auc") * F.col("n")) / F.sum("n")).alias("avg_auc"))
    by_version = g.groupBy("version").agg((F.sum(F.col("auc") * F.col("n")) / F.sum("n")).alias("avg_auc"))
    return by_family.select(F.lit("family").alias("by"), F.col("family").alias("value"), "avg_auc").unionByName(
        by_version.select(F.lit("version").alias("by"), F.col("version").cast("string").alias("value"), "avg_auc"))
