"""Past default rates kept up to date from a stream of labelled loans.

The streaming state is one pair of running sums, defaults and loans, per (key
column, key, month). Each trigger emits the pairs it changed; they are written as
whole totals, so writing a batch again after a restart changes nothing and a reader
takes the newest total of each pair. Sums don't depend on the order in which loans
arrive: any split into batches ends at the batch fit.

Loans may come late. Without ``delay`` every month's state is kept and none is too
late; the state is as large as the fitted table. With ``delay`` (such as "180 days")
a month whose first day is that far behind the newest one is closed and its state freed;
loans of closed or unknown months are left out then, and the query's progress counts
them (``numRowsDroppedByWatermark``).

Folders under ``path``: ``batch=<id>`` (changed totals), ``base=<id>`` (all totals up to
that batch, written every ``compact_every`` batches), ``_checkpoint``. A folder counts once
its ``_SUCCESS`` is there. The checkpoint lies with its tables as batch ids are only
meaningful together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.operators import encode
from riskframe.sources.io import _file
from riskframe.sources.loans import SPLIT, TARGET

PAIR = ["col", "key", "month"]


def month_sums(stream: DataFrame, keys: list[str], target: str = TARGET, month: str = "time_key", split: str = SPLIT, delay: str | None = None) -> DataFrame:
    """Running ``s, n`` per (col, key, month) of the stream's train loans."""
    sel = stream.where(F.col(split) == 1).select(
        F.col(month).alias("month"), F.col(target).cast("double").alias("__y"), F.explode(F.array(*[F.struct(F.lit(k).alias("col"), F.col(k).cast("string").alias("key")) for k in keys])).alias("__k")
    )
    long = sel.select("month", "__y", "__k.col", "__k.key").where(F.col("key").isNotNull())
    by = PAIR
    if delay is not None:
        first = F.try_to_timestamp((F.col("month") * 100 + 1).cast("string"), F.lit("yyyyMMdd"))
        long = long.withColumn("opened", first).where(F.col("opened").isNotNull()).withWatermark("opened", delay)
        by = [*PAIR, "opened"]
    return long.groupBy(*by).agg(F.sum("__y").alias("s"), F.count(F.lit(1)).alias("n")).select(*PAIR, "s", "n")


def _folders(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Committed ``base`` and ``batch`` numbers, ascending."""
    fs, root = _file(spark, path)
    out: dict[str, list[int]] = {"base": [], "batch": []}
    for st in fs.listStatus(root) if fs.exists(root) else []:
        kind, _, num = st.getPath().getName().partition("=")
        if kind in out and num.isdigit() and fs.exists(_file(spark, f"{path.rstrip('/')}/{kind}={num}/_SUCCESS")[1]):
            out[kind].append(int(num))
    return {k: sorted(v) for k, v in out.items()}


def totals(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """``col, key, month, s, n``: the newest totals, of the batches up to ``upto`` if given."""
    found = _folders(spark, path)
    fits = lambda k: upto is None or k <= upto
    base = max(filter(fits, found["base"]), default=-1)
    parts = [spark.read.parquet(f"{path.rstrip('/')}/base={base}").withColumn("__b", F.lit(base))] if base >= 0 else []
    parts += [spark.read.parquet(f"{path.rstrip('/')}/batch={b}").withColumn("__b", F.lit(b)) for b in found["batch"] if b > base and fits(b)]
    if not parts:
        return spark.createDataFrame([], "col string, key string, month int, s double, n bigint")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    new = rows.groupBy(*PAIR).agg(F.max_by(F.struct("s", "n"), "__b").alias("__v"))
    return new.select(*PAIR, "__v.s", "__v.n")


def merge_batch(batch: DataFrame, number: int, path: str, compact_every: int = 50) -> None:
    """Write one batch's totals; the same batch written again replaces itself."""
    spark = batch.sparkSession
    root = path.rstrip("/")
    batch.write.mode("overwrite").parquet(f"{root}/batch={number}")
    if (number + 1) % compact_every == 0:
        totals(spark, path, number).write.mode("overwrite").parquet(f"{root}/base={number}")
        old = [b for b in _folders(spark, path)["base"] if b < number]
        if old:  # readers may still hold what the base before was made of, but nothing older
            fs, _ = _file(spark, root)
            for kind, nums in _folders(spark, path).items():
                for k in nums:
                    if k < old[-1] or (kind == "batch" and k == old[-1]):
                        fs.delete(_file(spark, f"{root}/{kind}={k}")[1], True)


def start(stream: DataFrame, keys: list[str], path: str, delay: str | None = None, compact_every: int = 50, available_now: bool = False, trigger_seconds: int = 60, **names):
    """Start keeping the rates of ``stream``; ``names`` are the column names of :func:`month_sums`."""
    trigger = {"availableNow": True} if available_now else {"processingTime": f"{trigger_seconds} seconds"}
    return (
        month_sums(stream, keys, delay=delay, **names)
        .writeStream.outputMode("update")
        .foreachBatch(lambda df, number: merge_batch(df, number, path, compact_every))
        .option("checkpointLocation", f"{path.rstrip('/')}/_checkpoint")
        .trigger(**trigger)
        .start()
    )


def fitted(spark: SparkSession, path: str, keys: list[str]) -> encode.PastRate:
    """The past-rate table as fitted from the totals so far; apply it like a batch fit."""
    return encode.past_rate_from_sums(totals(spark, path), keys)
