"""Rank metrics without a row-level global sort.

Everything rank-based goes through :func:`score_table`: rows are aggregated per
distinct score (combined before the shuffle), the distinct scores are
range-partitioned by value and written, running sums run inside each range and
over the small table of range totals. The number of ranges follows the size of
the data (adaptive partition sizes), not a constant, and the result is exact
for any number. A group holding a third of all rows spreads over many ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def in_ranges(counts: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """The table written in ranges of ``order``, with the range's number as ``__part``.

    The rows are written first, so that sampling the range bounds doesn't run the
    plan behind them again, and the numbered ranges are written too, so that all
    readers see the same ones. ``parts`` fixes the number of ranges (for tests).
    """
    from riskframe.plans.common import forget, write_lean

    rows = write_lean(counts, "counts")
    dealt = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    ranges = write_lean(dealt.withColumn("__part", F.spark_partition_id()), "ranges")
    forget(rows)
    return ranges


def _same(left: DataFrame, right: DataFrame, cols: list[str], prefix: str = "__r_") -> DataFrame:
    """Inner join on ``cols`` where a null equals a null; the right side's copies are dropped."""
    renamed = right.select(*[F.col(c).alias(prefix + c) for c in cols], *[c for c in right.columns if c not in cols])
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).eqNullSafe(F.col(prefix + c))
    return left.join(renamed, cond).drop(*[prefix + c for c in cols])


def score_table(df: DataFrame, score: str, label: str | None, by: list[str] | tuple = (), parts: int | None = None) -> DataFrame:
    """Per (by…, distinct score): pos, neg, cnt and the sums strictly below.

    Columns: by…, __s, pos, neg, cnt, pos_below, neg_below, cnt_below.
    Rows with a non-finite score (or null label) are ignored (P9). A null in
    ``by`` is a group of its own.
    """
    by = list(by)
    s = F.col(score).cast("double")
    cond = _finite(s)
    y = F.lit(0.0)
    if label is not None:
        y = F.col(label).cast("double")
        cond = cond & _finite(y)
    rows = df.select(*by, s.alias("__s"), y.alias("__y")).filter(cond)
    g = rows.groupBy(*by, "__s").agg(
        F.sum("__y").alias("pos"), F.count(F.lit(1)).alias("cnt")
    ).withColumn("neg", F.col("cnt") - F.col("pos"))
    g = in_ranges(g, [*by, "__s"], parts)
    inner = Window.partitionBy(*by, "__part").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    within = g.select(
        *by, "__part", "__s", "pos", "neg", "cnt",
        F.coalesce(F.sum("pos").over(inner), F.lit(0.0)).alias("pb"),
        F.coalesce(F.sum("neg").over(inner), F.lit(0.0)).alias("nb"),
        F.coalesce(F.sum("cnt").over(inner), F.lit(0)).alias("cb"),
    )
    tot = g.groupBy(*by, "__part").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("tn"), F.sum("cnt").alias("tc"))
    outer = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(
        *by, "__part",
        F.coalesce(F.sum("tp").over(outer), F.lit(0.0)).alias("po"),
        F.coalesce(F.sum("tn").over(outer), F.lit(0.0)).alias("no"),
        F.coalesce(F.sum("tc").over(outer), F.lit(0)).alias("co"),
    )
    return _same(within, offs, [*by, "__part"]).select(
        *by, "__s", "pos", "neg", "cnt",
        (F.col("pb") + F.col("po")).alias("pos_below"),
        (F.col("nb") + F.col("no")).alias("neg_below"),
        (F.col("cb") + F.col("co")).alias("cnt_below"),
    )


def auc(df: DataFrame, score: str, label: str, by=(), parts: int | None = None) -> DataFrame:
    """M1/M2 tie-aware ROC AUC per group: Σ pos·(neg_below + neg/2) / (P·N).

    One class only (or no finite score) → null (safe AUC). Columns: by…, auc, n.
    """
    by = list(by)
    t = score_table(df, score, label, by, parts)
    agg = t.groupBy(*by).agg(
        F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)).alias("__num"),
        F.sum("pos").alias("__p"), F.sum("neg").alias("__n"), F.sum("cnt").alias("n"),
    )
    value = F.when((F.col("__p") > 0) & (F.col("__n") > 0), F.col("__num") / (F.col("__p") * F.col("__n")))
    return agg.select(*by, value.alias("auc"), F.col("n").cast("bigint").alias("n"))


def ks(df: DataFrame, score: str, label: str, by=(), parts: int | None = None) -> DataFrame:
    """M5 KS = max over thresholds t of TPR(≥t) − FPR(≥t)."""
    by = list(by)
    t = score_table(df, score, label, by, parts)
    totals = t.groupBy(*by).agg(F.sum("pos").alias("__P"), F.sum("neg").alias("__N"))
    if by:
        t = _same(t, totals, by)
    else:  # ungrouped: two scalars
        r = totals.first()
        t = t.withColumn("__P", F.lit(r["__P"])).withColumn("__N", F.lit(r["__N"]))
    diff = (F.col("__P") - F.col("pos_below")) / F.col("__P") - (F.col("__N") - F.col("neg_below")) / F.col("__N")
    return t.groupBy(*by).agg(
        F.max(F.when((F.col("__P") > 0) & (F.col("__N") > 0), diff)).alias("ks")
    )


def avg_rank(df: DataFrame, score: str, by=(), out: str = "rank", parts: int | None = None) -> DataFrame:
    """W2 average rank (ties share the mean of their positions, 1-based);
    non-finite scores get null."""
    by = list(by)
    t = score_table(df, score, None, by, parts).select(
        *[F.col(b).alias(f"__by_{b}") for b in by], F.col("__s").alias("__rs"),
        (F.col("cnt_below") + (F.col("cnt") + 1) / 2.0).alias(out),
    )
    cond = F.col(score).cast("double") == F.col("__rs")
    for b in by:
        cond = cond & F.col(b).eqNullSafe(F.col(f"__by_{b}"))
    return df.join(t, cond, "left").drop("__rs", *[f"__by_{b}" for b in by])


def minmax_normalize(df: DataFrame, col: str, by=(), out: str | None = None) -> DataFrame:
    """W5 (x − min) / (max − min + 1e-12) within each group (one small agg, joined back)."""
    by = list(by)
    out = out or col
    x = F.col(col).cast("double")
    if by:
        mm = df.groupBy(*by).agg(F.min(x).alias("__mn"), F.max(x).alias("__mx"))
        j = _same(df, mm, by)
        return j.withColumn(out, (x - F.col("__mn")) / (F.col("__mx") - F.col("__mn") + 1e-12)).drop("__mn", "__mx")
    r = df.agg(F.min(x), F.max(x)).first()
    mn, mx = r[0], r[1]
    if mn is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    return df.withColumn(out, (x - F.lit(mn)) / F.lit(mx - mn + 1e-12))


def classification_report(df: DataFrame, score: str, label: str, threshold: float = 0.5, by=()) -> DataFrame:
    """M5 confusion counts and the derived rates at one threshold."""
    by = list(by)
    yhat = (F.col(score) >= F.lit(threshold)).cast("int")
    y = F.col(label).cast("int")

    def cnt(c):
        return F.sum(F.when(c, 1).otherwise(0)).cast("bigint")

    agg = df.filter(y.isNotNull() & F.col(score).isNotNull()).groupBy(*by).agg(
        cnt((yhat == 1) & (y == 1)).alias("tp"), cnt((yhat == 1) & (y == 0)).alias("fp"),
        cnt((yhat == 0) & (y == 1)).alias("fn"), cnt((yhat == 0) & (y == 0)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    prec = F.when(tp + fp > 0, tp / (tp + fp))
    rec = F.when(tp + fn > 0, tp / (tp + fn))
    return agg.select(
        *by, "tp", "fp", "fn", "tn",
        ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"),
        prec.alias("precision"), rec.alias("recall"),
        F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).alias("f1"),
    )


def mae_rmse(df: DataFrame, a: str, b: str, by=()) -> DataFrame:
    """M6 mean absolute and root mean squared difference over finite pairs."""
    by = list(by)
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    d = x - y
    return df.filter(_finite(x) & _finite(y)).groupBy(*by).agg(
        F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.count(F.lit(1)).alias("rows_compared")
    )


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """G12 class counts and scale_pos_weight = neg / max(pos, 1)."""
    y = F.col(label).cast("int")
    agg = df.filter(y.isNotNull()).agg(
        F.sum(y).cast("bigint").alias("pos"), (F.count(F.lit(1)) - F.sum(y)).cast("bigint").alias("neg")
    )
    return agg.withColumn("scale_pos_weight", F.col("neg") / F.greatest(F.col("pos"), F.lit(1)))
