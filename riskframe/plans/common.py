"""Helpers shared by the query plans."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions import parse
from riskframe.session import checkpoint_dir
from riskframe.sources.io import remove_path

DIGITS = 6


def rnd(c, digits: int = DIGITS) -> Column:
    """Round a double for reporting (the oracle rounds the same way)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), digits)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by writing ``df`` as Parquet into the shared checkpoint folder.

    Used before a plan runs several fit jobs over the same input, so each job
    reads the written table (with column pruning and filter pushdown) instead
    of recomputing the joins behind it, and a lost executor costs a re-read,
    not a recomputation. Unlike ``Dataset.checkpoint`` the plan runs once.
    """
    return write_lean(df)


def write_table(df: DataFrame, name: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under this application's folder in the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    path = f"{_tables_dir(spark)}/{name or 't'}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def write_lean(df: DataFrame, name: str | None = None) -> DataFrame:
    """``write_table`` with little disk: compressed with zstd, and the shuffles of the plan go once the table is written."""
    spark = df.sparkSession
    path = f"{_tables_dir(spark)}/{name or 't'}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing, _lock = {}, Lock()


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of a plan that starts in here go when it ends: a written table is read, its plan isn't run again.

    Outside Spark keeps its own setting; the last of several threads puts it back.
    """
    with _lock:
        n, before = _writing.get(spark, (0, spark.conf.get(REMOVE_SHUFFLES, "false")))
        _writing[spark] = n + 1, before
        spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _writing[spark]
            if n > 1:
                _writing[spark] = n - 1, before
            else:
                del _writing[spark]
                spark.conf.set(REMOVE_SHUFFLES, before)


def forget(*frames: DataFrame | None) -> None:
    """Delete the intermediate tables that the frames read; other files they read stay.

    For tables that nothing reads any more: what has been computed from them is written or collected.
    """
    for df in frames:
        if df is None:
            continue
        root = _tables_dir(df.sparkSession)
        mark = f"/{root.rsplit('/', 1)[-1]}/"
        for name in {f.split(mark, 1)[1].split("/", 1)[0] for f in df.inputFiles() if mark in f}:
            remove_path(df.sparkSession, f"{root}/{name}")


def _tables_dir(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete every intermediate table this application has written.

    For the caller to use once no DataFrame built from them is needed any more.
    """
    remove_path(spark, _tables_dir(spark))


def with_time_columns(df: DataFrame, time_col: str = "issueDate") -> DataFrame:
    """Parsed issue date plus its month key (R4, R8)."""
    d = parse.parse_date(F.col(time_col))
    return df.withColumn(f"{time_col}_dt", d).withColumn("time_key", parse.time_key(d))


def dtype_of(df: DataFrame, col: str):
    return df.schema[col].dataType
