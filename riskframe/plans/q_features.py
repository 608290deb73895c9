"""Queries for the feature pipelines (E11-E14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, FloatType

from riskframe.plans.catalog import query
from riskframe.plans.common import rnd
from riskframe.plans.features import build_features


def rounded(df: DataFrame) -> DataFrame:
    """Round every floating column for comparison with the oracle."""
    return df.select(*[
        rnd(f.name).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else f.name
        for f in df.schema.fields
    ])


def _q(version):
    def run(spark, sf_dir):
        return rounded(build_features(spark, sf_dir, version).df)

    run.__doc__ = f"Feature table {version} over the whole loan view."
    return run


for _v in ("v1", "v2", "v3", "nb", "src"):
    query(f"features_{_v}")(_q(_v))
