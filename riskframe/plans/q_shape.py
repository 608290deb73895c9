"""Queries on the shape of the features: components, clusters, dependencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions.derive import N_COLS
from riskframe.operators import consistency, reduce
from riskframe.plans.catalog import query
from riskframe.plans.common import materialize, rnd
from riskframe.plans.q_encode import encoder_base
from riskframe.sources.loans import load_loans

DEPENDENCIES = [("postCode_cat", "regionCode"), ("subGrade", "grade"), ("purpose", "homeOwnership"), ("regionCode", "grade")]
N_CLUSTERS = 4


def _siblings(spark, sf_dir):
    loans = load_loans(spark, sf_dir)
    cols = [c for c in N_COLS if c in loans.columns]
    return materialize(loans.select("id", *cols)), cols


@query("pca_gram")
def q_pca_gram(spark, sf_dir):
    """Correlations of the sibling columns after mean filling, for every pair."""
    df, cols = _siblings(spark, sf_dir)
    gram = reduce.fit_gram(df, reduce.fit_scale(df, cols))
    rows = [(cols[i], cols[j], float(gram[i, j])) for i in range(len(cols)) for j in range(i, len(cols))]
    return spark.createDataFrame(rows, "col_a string, col_b string, value double").withColumn("value", rnd("value"))


@query("pca_variance")
def q_pca_variance(spark, sf_dir):
    """Variance over all rows of all components together: that of the scaled columns, whatever the rotation."""
    df, cols = _siblings(spark, sf_dir)
    out = reduce.add_components(df, reduce.fit_components(df, cols), len(cols))
    total = sum((F.var_pop(f"n_pc{k}") for k in range(2, len(cols) + 1)), F.var_pop("n_pc1"))
    return out.agg(F.count(F.lit(1)).alias("n_rows"), rnd(total).alias("variance"))


@query("pca_projection")
def q_pca_projection(spark, sf_dir):
    """The first three components of every loan."""
    df, cols = _siblings(spark, sf_dir)
    out = reduce.add_components(df, reduce.fit_components(df, cols), 3)
    return out.select("id", *[rnd(f"n_pc{k}").alias(f"n_pc{k}") for k in (1, 2, 3)])


@query("n_clusters")
def q_n_clusters(spark, sf_dir):
    """The cluster of every loan by its sibling columns, and the distance to its centre."""
    df, cols = _siblings(spark, sf_dir)
    out = reduce.add_cluster(df, reduce.fit_clusters(df, cols, "id", N_CLUSTERS))
    return out.select("id", "n_cluster", rnd("n_cluster_dist").alias("n_cluster_dist"))


def _dependent(spark, sf_dir):
    return encoder_base(spark, sf_dir, extra=("subGrade", "homeOwnership"))


@query("dependency_errors")
def q_dependency_errors(spark, sf_dir):
    """How far post codes decide regions, and three other dependencies."""
    return consistency.dependency_errors(_dependent(spark, sf_dir), DEPENDENCIES).withColumn("g3", rnd("g3"))


@query("dependency_conflicts")
def q_dependency_conflicts(spark, sf_dir):
    """The keys that hold several values."""
    return consistency.conflicts(_dependent(spark, sf_dir), DEPENDENCIES).withColumn("off_share", rnd("off_share"))
