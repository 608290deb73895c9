"""Fold assignment and sampling.

Every decision is a function of ``md5(id)`` — never ``rand()`` or
``monotonically_increasing_id`` — so task retries, re-runs and other engines
agree row for row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.operators.encode import hash_fold

__all__ = ["hash_fold", "kfold_assign", "stratified_folds", "hash_sample", "stratified_sample"]

# Rows of a class that one hash range of the stratified split holds on average.
RANGE_ROWS = 100_000


def _md5(id_col: str) -> Column:
    return F.md5(F.col(id_col).cast("string"))


def hash_unit(id_col: str) -> Column:
    """First 32 bits of md5(id) scaled to [0, 1)."""
    return F.conv(F.substring(_md5(id_col), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def kfold_assign(df: DataFrame, k: int = 5, id_col: str = "id", out: str = "fold") -> DataFrame:
    """T8 plain k-fold: md5(id) mod k."""
    return df.withColumn(out, hash_fold(F.col(id_col), k))


def stratified_folds(
    df: DataFrame, label: str, k: int = 5, id_col: str = "id", out: str = "fold"
) -> DataFrame:
    """T7 exactly balanced stratified folds: within each class, rows ordered by
    (md5(id), id) are dealt round-robin into k folds.

    The per-class row number is computed without a per-class global sort: the
    md5 order is cut into contiguous hash ranges, as many as the row count asks
    for, rows are numbered inside (class, range), and the counts of the class's
    earlier ranges give the offset. The folds don't depend on the number.
    """
    h = _md5(id_col)
    n, digits = df.count(), 1
    while n > RANGE_ROWS * 16**digits:
        digits += 1
    rows = df.withColumn("__h", h).withColumn("__hb", F.substring("__h", 1, digits))
    counts = rows.groupBy(label, "__hb").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(label).orderBy("__hb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(label).alias("__lab"), F.col("__hb").alias("__ob"),
        F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off"),
    )
    inner = Window.partitionBy(label, "__hb").orderBy("__h", id_col)
    numbered = rows.withColumn("__rn", F.row_number().over(inner))
    j = numbered.join(
        offsets, F.col(label).eqNullSafe(F.col("__lab")) & (F.col("__hb") == F.col("__ob")), "left"
    )
    return j.withColumn(out, ((F.col("__off") + F.col("__rn") - 1) % k).cast("int")).drop(
        "__h", "__hb", "__rn", "__lab", "__ob", "__off"
    )


def hash_sample(df: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    """T5 a seeded-free deterministic sample of n rows: the n smallest md5(id).

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each task keeps its
    own top n and only n rows per task reach the final merge.
    """
    return df.orderBy(_md5(id_col), F.col(id_col)).limit(n)


def stratified_sample(df: DataFrame, label: str, fraction: float, id_col: str = "id") -> DataFrame:
    """T6 per-stratum deterministic sample: keep rows whose md5 fraction is
    below ``fraction`` (the same share of every class, independent of order)."""
    return df.filter(hash_unit(id_col) < F.lit(fraction))
