"""Structured Streaming: encode newly arriving loans with fitted tables.

The batch pipeline fits its encoder tables on the train history; loans that
arrive later are "test rows" of those fits. This module applies the fitted
past-rate and frequency tables to a stream of new loan files with
stream-static joins — the same apply step test rows get in batch, so no
state is kept per key and the stream scales with the arrival rate.

Sinks should be idempotent (Parquet with a checkpoint location in the shared
checkpoint folder), so a restarted query resumes exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskframe.operators.encode import PastRate


def past_rate_lookup(model: PastRate, key: str) -> DataFrame:
    """The test-time rates of one key column as a static (key, rate) table."""
    t = model.table.filter((F.col("col") == key) & (F.col("month") == -1))
    return t.select(F.col("key").alias(f"__{key}"), F.col("rate").alias(f"__rate_{key}"))


def encode_stream(stream: DataFrame, model: PastRate, keys: list[str]) -> DataFrame:
    """Add ``hist_rate_<key>`` to every streamed row (stream-static left joins)."""
    out = stream
    for k in keys:
        lk = past_rate_lookup(model, k)
        out = out.join(lk, F.col(k).cast("string") == F.col(f"__{k}"), "left")
        out = out.withColumn(f"hist_rate_{k}", F.coalesce(F.col(f"__rate_{k}"), F.lit(model.global_rate[k])))
        out = out.drop(f"__{k}", f"__rate_{k}")
    return out


def read_loan_stream(spark: SparkSession, path: str, schema: StructType, max_files: int = 16) -> DataFrame:
    """New loan Parquet files under ``path`` as a stream (explicit schema)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def start_scoring(stream: DataFrame, out_path: str, checkpoint: str, trigger_seconds: int = 60):
    """Append encoded rows to Parquet; the checkpoint makes restarts exactly-once."""
    return (stream.writeStream.format("parquet").option("path", out_path)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(processingTime=f"{trigger_seconds} seconds").start())
