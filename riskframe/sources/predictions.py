"""Prediction tables (SURVEY §2.1 S8/S9, §1 "Predictions").

Long format ``(run, split, id, y, pred)``: one row per run and loan, ``split``
'oof' for train rows (out-of-fold scores, with the target) and 'sub' for test
rows. Partitioning by ``run`` keeps each run's rows together on write.

``score_runs`` derives deterministic scores from the loan tables so that the
metric and blending operators have a fully reproducible input: four past
default rates (by region, grade, purpose, post code — each computed only from
earlier months) and a smoothed share of open lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.operators import encode

RUN_KEYS = {"hist_region": "regionCode", "hist_grade": "grade", "hist_purpose": "purpose",
            "hist_postcode": "postCode_cat"}


RUNS = list(RUN_KEYS) + ["open_share"]


def score_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per loan: id, is_train, isDefault, time_key and one column per run."""
    from riskframe.plans.q_encode import encoder_base

    base = encoder_base(spark, sf_dir, extra=("n0", "n4"))
    df = encode.past_rate(base, list(RUN_KEYS.values()))
    return df.select(
        "id", "is_train", "isDefault", "time_key",
        *[F.col(f"hist_rate_{k}").alias(r) for r, k in RUN_KEYS.items()],
        ((F.col("n4") + 1) / (F.col("n0") + 2)).alias("open_share"),
    )


def score_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskframe.plans.common import materialize

    wide = score_wide(spark, sf_dir).drop("time_key")
    runs = RUNS
    long = wide.unpivot(["id", "is_train", "isDefault"], runs, "run", "pred").select(
        "run", F.when(F.col("is_train") == 1, "oof").otherwise("sub").alias("split"),
        "id", F.col("isDefault").alias("y"), "pred",
    )
    return materialize(long)


def clip_submission(df: DataFrame, pred: str = "pred") -> DataFrame:
    """S8 predictions clipped to [0, 1] before writing."""
    return df.withColumn(pred, F.greatest(F.least(F.col(pred), F.lit(1.0)), F.lit(0.0)))


def write_predictions(df: DataFrame, path: str) -> None:
    """S8 sink: one folder per run (``run=<name>``), Parquet."""
    clip_submission(df).write.mode("overwrite").partitionBy("run").parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """S9 run discovery: every ``run=<name>`` folder under ``path`` is a run;
    runs lacking either split are skipped (a run needs both oof and sub rows)."""
    df = spark.read.parquet(path)
    complete = df.groupBy("run").agg(F.countDistinct("split").alias("n")).filter("n = 2").select("run")
    return df.join(complete, "run", "left_semi")


def adapt_run_file(df: DataFrame, run: str, split: str, id_col: str = "id", target: str = "isDefault") -> DataFrame:
    """P6 bring one run's file to the long layout: the last column that is
    neither the id nor the target is the prediction; the target (if present)
    becomes ``y``."""
    scores = df.drop(id_col, target).columns
    if not scores:
        raise ValueError("no prediction column")
    has_y = target in df.columns
    return df.select(F.lit(run).alias("run"), F.lit(split).alias("split"), F.col(id_col).alias("id"),
                     (F.col(target) if has_y else F.lit(None)).cast("int").alias("y"),
                     F.col(scores[-1]).cast("double").alias("pred"))


def discover_run_files(spark: SparkSession, root: str, target: str = "isDefault") -> DataFrame:
    """S9 the long prediction table from per-run files under ``root``.

    A run is a folder with a file ``oof_*`` (out-of-fold) and one ``submission*``
    (test rows), CSV or Parquet; folders directly under ``root`` are looked at
    first, and if none is a run, those at any depth. Runs lacking either are
    skipped. The listing is the driver's; the rows are read by Spark.
    """
    from riskframe.sources.io import _file

    fs, base = _file(spark, root)

    def files_in(folder) -> dict[str, str]:
        found: dict[str, str] = {}
        for st in fs.listStatus(folder):
            name = st.getPath().getName()
            for kind, prefix in (("oof", "oof_"), ("sub", "submission")):
                if name.startswith(prefix) and (name.endswith(".csv") or name.endswith(".parquet")):
                    found[kind] = min(found.get(kind, st.getPath().toString()), st.getPath().toString())
        return found

    def folders_in(folder) -> list:
        return [st.getPath() for st in fs.listStatus(folder) if st.isDirectory() and not st.getPath().getName().endswith(".parquet")]

    def runs_of(folders) -> dict[str, dict[str, str]]:
        held = {f.getName(): files_in(f) for f in folders}
        return {n: f for n, f in sorted(held.items()) if len(f) == 2}

    level = folders_in(base)
    runs = runs_of(level)
    while not runs and level:
        level = [g for f in level for g in folders_in(f)]
        runs = runs_of(level)
    parts = []
    for run, held in runs.items():
        for split, path in held.items():
            df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True, inferSchema=True)
            parts.append(adapt_run_file(df, run, split, target=target))
    if not parts:
        raise FileNotFoundError(f"no run with oof_* and submission* files under {root}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
