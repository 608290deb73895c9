"""Feature-table audits.

Each audit is one or two aggregate jobs over the whole table — no sampling,
no driver loops over months or columns: columns are unpivoted into rows and
months become a grouping key, so every (column, month) statistic comes out of
the same job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, NumericType

from riskframe.operators import metrics


def numeric_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and not isinstance(f.dataType, DecimalType)]


def list_by_prefix(cols: list[str], prefix: str) -> list[str]:
    """P5 columns starting with ``prefix``, order kept, duplicates dropped."""
    return list(dict.fromkeys(c for c in cols if c.startswith(prefix)))


def list_by_text(cols: list[str], text: str) -> list[str]:
    """P5 columns whose name contains ``text``, order kept, duplicates dropped."""
    return list(dict.fromkeys(c for c in cols if text in c))


def basic_profile(df: DataFrame, target: str) -> DataFrame:
    """A1/X1 shape, column-type counts and positive rate (one job)."""
    n_num = len(numeric_cols(df))
    n_str = sum(1 for f in df.schema.fields if f.dataType.typeName() == "string")
    agg = [F.count(F.lit(1)).alias("n_rows")]
    agg.append(F.avg(F.col(target).cast("double")).alias("target_pos_rate") if target in df.columns
               else F.lit(None).cast("double").alias("target_pos_rate"))
    return df.agg(*agg).select(
        "n_rows", F.lit(len(df.columns)).alias("n_cols"), F.lit(n_num).alias("n_num"),
        F.lit(n_str).alias("n_str"), "target_pos_rate",
    )


def missing_inf(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A6/G6 null ratio (NaN counted as missing) and ±inf count per numeric
    column: one wide aggregate, unpivoted to (col, nan_ratio, n_inf)."""
    cols = cols or numeric_cols(df)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs.append(F.struct(
            F.avg((x.isNull() | F.isnan(x)).cast("double")).alias("nan_ratio"),
            F.sum((F.abs(x) == F.lit(float("inf"))).cast("long")).alias("n_inf"),
        ).alias(c))
    long = df.agg(*aggs).unpivot([], cols, "col", "s")
    return long.select("col", F.col("s.nan_ratio").alias("nan_ratio"),
                       F.coalesce(F.col("s.n_inf"), F.lit(0)).alias("n_inf"))


def woe_summary(df: DataFrame, target: str, cols: list[str] | None = None) -> DataFrame:
    """A2 per WOE column: null ratio, inf count, mean, population std of the
    finite values, and the single-column AUC against the target."""
    cols = cols or list_by_prefix(df.columns, "woe_")
    health = missing_inf(df, cols)
    long = df.select(target, *cols).unpivot([target], cols, "col", "v")
    fin = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < F.lit(float("inf")))
    moments = long.filter(fin).groupBy("col").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    auc = metrics.auc(long, "v", target, by=["col"]).select("col", F.col("auc").alias("auc_vs_target"))
    return health.join(moments, "col", "left").join(auc, "col", "left")


def last_n_months_bound(df: DataFrame, time_key: str, n: int):
    """P11 the N-th latest distinct month (None when n = 0: keep all).

    The distinct-month table is tiny (one row per month); only its N-th
    latest value reaches the driver, as a literal bound for a filter."""
    if not n:
        return None
    rows = df.select(time_key).distinct().orderBy(F.desc(time_key)).limit(n).collect()
    return min(r[0] for r in rows) if rows else None


def last_n_months(df: DataFrame, time_key: str, n: int) -> DataFrame:
    """P11 rows of the N latest distinct months."""
    bound = last_n_months_bound(df, time_key, n)
    return df if bound is None else df.filter(F.col(time_key) >= F.lit(bound))


def _month_filter(df: DataFrame, time_key: str, max_months: int, col: str | None = None):
    bound = last_n_months_bound(df, time_key, max_months)
    return None if bound is None else F.col(col or time_key) >= F.lit(bound)


def audit_time_aware_te(df: DataFrame, target: str, time_key: str = "time_key",
                        te_cols: list[str] | None = None, max_months: int = 0) -> DataFrame:
    """A3 recompute, for every month m, the key's target mean over all rows of
    months < m (unseen key → mean of all rows before m) and compare with the
    stored ``te_<key>``; per-month MAE/RMSE averaged over the checked months.

    Output (te_col, mae, rmse, check_months, rows_compared). Columns whose key
    column is absent get null errors and 0 rows.
    """
    te_cols = te_cols or list_by_prefix(df.columns, "te_")
    present = [c for c in te_cols if c[3:] in df.columns]
    n_months = df.select(time_key).distinct().count()
    if max_months:
        n_months = min(n_months, max_months)
    if not present:
        return df.sparkSession.createDataFrame(
            [], "te_col string, mae double, rmse double, check_months int, rows_compared bigint")
    # one scan: a struct per encoded column, unpivoted
    long = df.select(*[
        F.struct(F.lit(c).alias("te_col"), F.col(c[3:]).cast("string").alias("key"), F.col(time_key).alias("m"),
                 F.col(target).cast("double").alias("y"), F.col(c).cast("double").alias("real")).alias(c)
        for c in present]).unpivot([], present, "c", "s").select("s.*")
    by_key = long.filter(F.col("key").isNotNull()).groupBy("te_col", "key", "m").agg(
        F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"))
    wk = Window.partitionBy("te_col", "key").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    past_key = by_key.select("te_col", "key", "m", F.sum("s").over(wk).alias("ks"), F.sum("n").over(wk).alias("kn"))
    by_month = df.groupBy(F.col(time_key).alias("m")).agg(
        F.sum(F.col(target).cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    wm = Window.orderBy("m").rowsBetween(Window.unboundedPreceding, -1)  # one row per month
    past_month = by_month.select("m", F.sum("s").over(wm).alias("ps"), F.sum("n").over(wm).alias("pn"))
    j = (long.join(past_month, "m")
         .join(past_key, ["te_col", "key", "m"], "left")
         .filter(F.col("pn") > 0))
    mf = _month_filter(df, time_key, max_months, "m")
    if mf is not None:
        j = j.filter(mf)
    mapped = F.coalesce(F.col("ks") / F.col("kn"), F.col("ps") / F.col("pn"))
    d = (mapped - F.col("real"))
    fin = F.col("real").isNotNull() & ~F.isnan("real") & (F.abs("real") < F.lit(float("inf")))
    per_month = j.filter(fin).groupBy("te_col", "m").agg(
        F.avg(F.abs(d)).alias("mae_m"), F.sqrt(F.avg(d * d)).alias("rmse_m"), F.count(F.lit(1)).alias("n_m"))
    return per_month.groupBy("te_col").agg(
        F.avg("mae_m").alias("mae"), F.avg("rmse_m").alias("rmse"),
        F.lit(n_months).alias("check_months"), F.sum("n_m").alias("rows_compared"))


def audit_past_rate(df: DataFrame, target: str, time_key: str = "time_key",
                    hist_cols: list[str] | None = None, max_months: int = 0) -> DataFrame:
    """A4 recompute each ``hist_rate_<key>`` (Σy/n of the key over strictly
    earlier months, global rate when none) over the full history, then
    compare on the checked months. Output (hist_col, key_col, mae, rmse,
    rows_compared). A correct build gives 0."""
    hist_cols = hist_cols or list_by_prefix(df.columns, "hist_rate_")
    keys = [h[len("hist_rate_"):] for h in hist_cols if h[len("hist_rate_"):] in df.columns]
    # Own arithmetic, not the encoder's: running totals up to and including the
    # month, less the month itself.
    long = df.select(*[
        F.struct(F.lit(k).alias("key_col"), F.col(k).cast("string").alias("key"), F.col(time_key).alias("m"),
                 F.col(target).cast("double").alias("y"), F.col(f"hist_rate_{k}").cast("double").alias("real")).alias(k)
        for k in keys]).unpivot([], keys, "k", "s").select("s.*")
    month = long.filter(F.col("key").isNotNull()).groupBy("key_col", "key", "m").agg(
        F.sum("y").alias("bad"), F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("key_col", "key").orderBy("m")
    bad, n = F.sum("bad").over(upto) - F.col("bad"), F.sum("n").over(upto) - F.col("n")
    past = month.select("key_col", "key", "m", F.when(n > 0, bad / n).alias("past"))
    overall = month.groupBy("key_col").agg((F.sum("bad") / F.sum("n")).alias("overall"))  # one row per column
    out = long.join(past, ["key_col", "key", "m"], "left").join(overall, "key_col", "left")
    mf = _month_filter(df, time_key, max_months, "m")
    if mf is not None:
        out = out.filter(mf)
    out = out.select(F.concat(F.lit("hist_rate_"), "key_col").alias("hist_col"), "key_col", F.coalesce("past", "overall").alias("mapped"), "real")
    d = F.col("mapped") - F.col("real")
    fin = F.col("real").isNotNull() & ~F.isnan("real") & (F.abs("real") < F.lit(float("inf")))
    return out.filter(fin & F.col("mapped").isNotNull()).groupBy("hist_col", "key_col").agg(
        F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.count(F.lit(1)).alias("rows_compared"))


def monthly_auc(df: DataFrame, target: str, score_cols: list[str], time_key: str = "time_key",
                max_months: int = 0) -> DataFrame:
    """A5 AUC of every score column in every month, one job: (time_key, col, auc, n)."""
    long = df.select(time_key, target, *score_cols).unpivot([time_key, target], score_cols, "col", "v")
    mf = _month_filter(df, time_key, max_months)
    if mf is not None:
        long = long.filter(mf)
    rows = df if mf is None else df.filter(mf)
    n = rows.groupBy(F.col(time_key).alias("m")).agg(F.count(F.lit(1)).alias("n"))  # one row per month
    n = n.select("m", "n", F.explode(F.array(*[F.lit(c) for c in score_cols])).alias("c"))
    a = metrics.auc(long, "v", target, by=[time_key, "col"]).select(F.col(time_key).alias("am"), F.col("col").alias("ac"), "auc")
    same = F.col("m").eqNullSafe(F.col("am")) & (F.col("c") == F.col("ac"))
    return n.join(a, same, "left").select(F.col("m").alias(time_key), F.col("c").alias("col"), "auc", "n")


def audit_flags(report: DataFrame, col: str = "te_col", threshold: float = 1e-6, top: int = 5) -> DataFrame:
    """A7 suspicious columns: MAE above ``threshold`` with rows compared, worst first."""
    return (report.filter((F.col("mae") > threshold) & (F.col("rows_compared") > 0))
            .orderBy(F.desc("mae"), col).limit(top))
