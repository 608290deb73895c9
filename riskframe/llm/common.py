"""Small helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.plans.common import write_table

__all__ = ["Shared", "ascii_lower", "clean_text", "fresh", "latest", "load", "shuffle_partitions", "small_batches", "write_table"]

ASCII_SPACE = "[\\x20\\x09-\\x0D]+"


class Shared:
    """A broadcast value with its id, which Python workers use as the key of what they build from it."""

    def __init__(self, spark: SparkSession, value):
        self.box = spark.sparkContext.broadcast(value)
        self.id = self.box._jbroadcast.id()

    def __getstate__(self):
        return {"box": self.box, "id": self.id}

    @property
    def value(self):
        return self.box.value


_LATEST: list = [None, None]


def latest(shared: Shared, build):
    """What a Python worker has built from a broadcast value; only the last one is
    kept, since a worker that goes on to another operator is the same process."""
    if _LATEST[0] != shared.id:
        _LATEST[:] = [None, None]  # the old one goes before the new one is built
        _LATEST[:] = [shared.id, build(shared.value)]
    return _LATEST[1]


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Bound the rows of an Arrow batch: texts are long, and a batch is held on both sides of the worker's pipe."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Names for temporary columns that none of the table's columns has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def clean_text(col: str) -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case so that ASCII letters come out as if only A-Z were mapped.

    ``lower`` maps two non-ASCII letters (U+0130, U+212A) to text with an ASCII
    letter in it; they are replaced by another non-ASCII letter first. Other
    non-ASCII letters may change case, which no ASCII pattern can see.
    """
    return F.lower(F.replace(F.replace(c, F.lit("İ"), F.lit("å")), F.lit("K"), F.lit("å")))
