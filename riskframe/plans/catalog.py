"""Registry of named queries: ``name -> f(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (through the ``loans`` view or directly)
over whole tables; the matching DuckDB oracle text lives in ``oracle/``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = fn
        return fn

    return deco


def all_queries() -> dict[str, QueryFn]:
    # Import for side effects: each module registers its queries.
    from riskframe.plans import (  # noqa: F401
        q_audit,
        q_blend,
        q_encode,
        q_features,
        q_metrics,
        q_parse,
        q_report,
        q_shape,
        q_train,
    )

    return dict(REGISTRY)
