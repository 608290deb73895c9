"""Does one column decide another? Approximate functional dependencies and their conflicts.

The error of ``lhs -> rhs`` is the least share of rows to remove so that every key
has one value (g3). All dependencies share one scan: rows are counted per (dependency,
key, value), which combines before the shuffle, and a key's most frequent value comes
from those counts. A hot key is as many counts as it has distinct values, never its rows.
Keys and values are compared as text. A null key is no key and left out; a null value
is a value. Of equally frequent values the least counts as the key's own, null last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_values(df: DataFrame, dependencies: list[tuple[str, str]]) -> DataFrame:
    """Per dependency and key: ``lhs, rhs, key, rows, n_values, value, kept``."""
    as_text = lambda c: F.col(c).cast("string")
    each = F.array(*[F.struct(F.lit(a).alias("lhs"), F.lit(b).alias("rhs"), as_text(a).alias("key"), as_text(b).alias("value")) for a, b in dependencies])
    pairs = df.select(F.explode(each).alias("p")).select("p.*").where(F.col("key").isNotNull())
    counts = pairs.groupBy("lhs", "rhs", "key", "value").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct((-F.col("n")).alias("m"), F.col("value").isNull().alias("none"), "value"))
    out = counts.groupBy("lhs", "rhs", "key").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("n_values"), first.alias("f"))
    return out.select("lhs", "rhs", "key", "rows", "n_values", "f.value", (-F.col("f.m")).alias("kept"))


def dependency_errors(df: DataFrame, dependencies: list[tuple[str, str]]) -> DataFrame:
    """Per dependency: ``rows, n_keys, n_conflicts`` (keys with several values) and ``g3``. None for one without keys."""
    per = key_values(df, dependencies).groupBy("lhs", "rhs")
    return per.agg(
        F.sum("rows").alias("rows"),
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(F.col("n_values") > 1).alias("n_conflicts"),
        (F.lit(1.0) - F.sum("kept") / F.sum("rows")).alias("g3"),
    )


def conflicts(df: DataFrame, dependencies: list[tuple[str, str]]) -> DataFrame:
    """The keys with several values: their own value, the rows that hold it and the share of rows that don't."""
    per = key_values(df, dependencies).where(F.col("n_values") > 1)
    return per.withColumn("off_share", F.lit(1.0) - F.col("kept") / F.col("rows"))
