"""Fit-then-apply encoders.

Pattern: ``fit_*`` runs one aggregate job and returns either a small keyed
table (one row per category, or per category × month/block/fold) or a handful
of driver-side scalars (a prior, quantile edges, at most ``q`` bin weights);
``apply_*`` joins the table back or evaluates the scalars as literals.

Scale notes
- All statistics are computed on aggregates, never on row-level windows: the
  only windows run over ``(key, month)`` / ``(key, block)`` aggregates, whose
  size is bounded by #keys × #months, partitioned by key.
- A hot key (one key holding a large share of rows) costs nothing extra: the
  hash aggregate combines map-side before the shuffle, and the lookup join is
  either broadcast (AQE, runtime size check) or a sort-merge join that AQE
  splits when a partition is skewed.
- Fold and block assignments are deterministic functions of the id / month, so
  task retries after executor loss recompute identical values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.sources.loans import SPLIT, TARGET


def _written(df: DataFrame) -> DataFrame:
    """Write a fitted table to the shared checkpoint folder and read it back.

    Fitted tables are small (one row per key × fold/block/month) but feed one
    join per encoded column; writing them once keeps every join from
    re-running the aggregation, and survives executor loss.
    """
    from riskframe.plans.common import write_lean

    return write_lean(df, "fit")


def _is_train(split: str = SPLIT) -> Column:
    return F.col(split) == 1


def _dbl(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


# --------------------------------------------------------------------------
# E1 frequency encoding / E2 train-count encoding
# --------------------------------------------------------------------------


def fit_freq(df: DataFrame, cols: list[str]) -> DataFrame:
    """E1 share of each value over all rows, for several columns in one pass.

    Values are compared as text with null as the value 'nan' (a null is a
    category of its own). Returns (col, key, freq).
    """
    keyed = df.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in cols]
    )
    long = keyed.unpivot([], cols, "col", "key")
    counts = long.groupBy("col", "key").agg(F.count(F.lit(1)).alias("n"))
    total = df.count()
    return _written(counts.select("col", "key", (F.col("n") / F.lit(float(max(total, 1)))).alias("freq")))


def apply_freq(df: DataFrame, table: DataFrame, col: str, out: str | None = None, few: bool = False) -> DataFrame:
    """``few``: the column has few values (:func:`few_valued`), so they are sent to all rows."""
    out = out or f"{col}_freq"
    t = table.filter(F.col("col") == col).select(
        F.col("key").alias("__fk"), F.col("freq").alias(out)
    )
    key = F.coalesce(F.col(col).cast("string"), F.lit("nan"))
    return df.join(F.broadcast(t) if few else t, key == F.col("__fk"), "left").drop("__fk")


def freq_encode(df: DataFrame, cols: list[str], suffix: str = "_freq") -> DataFrame:
    table = fit_freq(df, cols)
    for c in cols:
        df = apply_freq(df, table, c, f"{c}{suffix}")
    return df


def fit_train_count(df: DataFrame, cols: list[str], split: str = SPLIT) -> DataFrame:
    """E2 fit: train-row count per value for several columns, one pass.
    Returns (col, key, n); a null value is kept as its own key."""
    long = df.filter(_is_train(split)).select(
        *[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("key")).alias(c) for c in cols]
    ).unpivot([], cols, "c", "s").select("s.col", "s.key")
    return _written(long.groupBy("col", "key").agg(F.count(F.lit(1)).cast("double").alias("n")))


def apply_train_count(df: DataFrame, table: DataFrame, col: str, out: str | None = None) -> DataFrame:
    out = out or f"{col}_freq"
    t = table.filter(F.col("col") == col).select(F.col("key").alias("__ck"), F.col("n").alias("__cn"))
    return (df.join(t, F.col(col).cast("string").eqNullSafe(F.col("__ck")), "left")
            .withColumn(out, F.coalesce(F.col("__cn"), F.lit(0.0))).drop("__ck", "__cn"))


def train_count_encode(df: DataFrame, col: str, out: str | None = None, split: str = SPLIT) -> DataFrame:
    """E2 number of train rows holding the value; unseen values → 0."""
    return apply_train_count(df, fit_train_count(df, [col], split), col, out)


# --------------------------------------------------------------------------
# Fold / block helpers
# --------------------------------------------------------------------------


def hash_fold(id_col: Column, k: int) -> Column:
    """T8 fold = first 32 bits of md5(id) mod k (same value in any engine)."""
    h = F.conv(F.substring(F.md5(id_col.cast("string")), 1, 8), 16, 10).cast("bigint")
    return (h % k).cast("int")


def _long_keys(df: DataFrame, keys: list[str], extra: list) -> DataFrame:
    """Unpivot key columns to (col, key) rows — one scan serves every column.

    Keys are compared as text so columns of different types share one table;
    null keys are dropped (they never match a lookup).
    """
    sel = df.select(*extra, *[F.col(k).cast("string").alias(k) for k in keys])
    ids = sel.columns[: len(extra)]
    return sel.unpivot(ids, keys, "col", "key").filter(F.col("key").isNotNull())


def _as_list(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _lookup(df: DataFrame, table: DataFrame, key: str, slot: Column, slot_name: str) -> DataFrame:
    """Left join of the rows of ``table`` that belong to column ``key``.

    The table's columns arrive prefixed with ``__`` so they never collide with
    the caller's; callers drop them after use.
    """
    t = table.filter(F.col("col") == key).drop("col")
    t = t.select(*[F.col(c).alias(f"__{c}") for c in t.columns])
    cond = (F.col(key).cast("string") == F.col("__key")) & (slot == F.col(f"__{slot_name}"))
    return df.join(t, cond, "left")


# --------------------------------------------------------------------------
# E3 k-fold target encoding
# --------------------------------------------------------------------------


@dataclass
class KFoldTE:
    table: DataFrame  # (col, key, fold, s, n); fold = -1 holds the all-train totals
    prior: float
    m: float
    k: int


def fit_kfold_te(
    df: DataFrame, keys, target: str = TARGET, k: int = 5, m: float = 50.0,
    id_col: str = "id", split: str = SPLIT,
) -> KFoldTE:
    """E3 smoothed out-of-fold mean, every key column in one aggregation.

    Per (column, key, fold) sums are computed once; a row in fold f is encoded
    with the key totals minus its own fold's share — no k scans of the data.
    """
    keys = _as_list(keys)
    train = df.filter(_is_train(split))
    prior = train.agg(F.avg(_dbl(target))).first()[0]
    prior = 0.5 if prior is None else float(prior)
    long = _long_keys(
        train, keys, [hash_fold(F.col(id_col), k).alias("fold"), _dbl(target).alias("__y")]
    )
    by_fold = long.groupBy("col", "key", "fold").agg(
        F.sum("__y").alias("s_f"), F.count(F.lit(1)).alias("n_f")
    )
    w = Window.partitionBy("col", "key")
    out_of_fold = by_fold.select(
        "col", "key", "fold",
        (F.sum("s_f").over(w) - F.col("s_f")).alias("s"),
        (F.sum("n_f").over(w) - F.col("n_f")).alias("n"),
    )
    totals = by_fold.groupBy("col", "key").agg(
        F.lit(-1).alias("fold"), F.sum("s_f").alias("s"), F.sum("n_f").alias("n")
    )
    return KFoldTE(_written(out_of_fold.unionByName(totals)), prior, m, k)


def apply_kfold_te(
    df: DataFrame, model: KFoldTE, key: str, out: str | None = None,
    id_col: str = "id", split: str = SPLIT,
) -> DataFrame:
    out = out or f"te_{key}"
    joined = _lookup(df, model.table, key, _fold_slot(model, id_col, split), "fold")
    return joined.withColumn(out, _kfold_value(model, key, F.col("__s"), F.col("__n"))).drop("__key", "__fold", "__s", "__n")


def _fold_slot(model: KFoldTE, id_col: str, split: str) -> Column:
    return F.when(_is_train(split), hash_fold(F.col(id_col), model.k)).otherwise(F.lit(-1))


def _kfold_value(model: KFoldTE, key: str, s: Column, n: Column) -> Column:
    prior, m = F.lit(model.prior), F.lit(model.m)
    enc = (F.coalesce(s, F.lit(0.0)) + prior * m) / (F.coalesce(n, F.lit(0)) + m)
    return F.when(F.col(key).isNull(), prior).otherwise(enc)


def kfold_target_encode(df, keys, target=TARGET, k=5, m=50.0, id_col="id", split=SPLIT):
    """Fit on ``df`` once for all ``keys``, then add ``te_<key>`` columns."""
    keys = _as_list(keys)
    model = fit_kfold_te(df, keys, target, k, m, id_col, split)
    for key in keys:
        df = apply_kfold_te(df, model, key, None, id_col, split)
    return df


# --------------------------------------------------------------------------
# E4 time blocks / E5 time-aware (block) target mean
# --------------------------------------------------------------------------


def fit_time_blocks(
    df: DataFrame, month: str = "time_key", n_blocks: int = 5, min_train_gap: int = 1,
    split: str = SPLIT,
) -> DataFrame:
    """E4 distinct train months (> 0) cut into contiguous blocks.

    Returns (month, block, valid): ``ntile`` over the distinct months gives the
    larger blocks first; a block is valid when at least ``min_train_gap``
    months precede its first month. The table has one row per distinct month,
    so the global window runs on a few hundred rows at most.
    """
    months = (
        df.filter(_is_train(split) & (F.col(month) > 0)).select(F.col(month).alias("month")).distinct()
    )
    n_months = months.count()
    k = n_blocks if n_months >= n_blocks else max(2, n_months)
    order = Window.orderBy("month")
    blocks = months.select(
        "month", F.ntile(k).over(order).alias("block"), F.row_number().over(order).alias("rn")
    )
    start = Window.partitionBy("block")
    return blocks.select(
        "month", "block", ((F.min("rn").over(start) - 1) >= min_train_gap).alias("valid")
    )


@dataclass
class BlockTE:
    table: DataFrame  # (col, key, block, s, n); block = -1 holds all-train sums
    blocks: DataFrame  # (month, block, valid)
    prior: float
    any_valid: bool


def fit_block_te(
    df: DataFrame, keys, target: str = TARGET, month: str = "time_key",
    n_blocks: int = 5, min_train_gap: int = 1, split: str = SPLIT, blocks: DataFrame | None = None,
) -> BlockTE:
    """E5 mean of the target per key over all strictly earlier blocks.

    One aggregation to (column, key, month) for every key column; the running
    sums run per (column, key) over block aggregates — never over rows.
    """
    keys = _as_list(keys)
    if blocks is None:
        blocks = fit_time_blocks(df, month, n_blocks, min_train_gap, split)
    train = df.filter(_is_train(split))
    stats = train.agg(F.avg(_dbl(target))).first()
    prior = 0.5 if stats[0] is None else float(stats[0])
    any_valid = bool(blocks.agg(F.max(F.col("valid").cast("int"))).first()[0])
    long = _long_keys(train, keys, [F.col(month).alias("month"), _dbl(target).alias("__y")])
    per_month = long.groupBy("col", "key", "month").agg(
        F.sum("__y").alias("s_m"), F.count(F.lit(1)).alias("n_m")
    )
    per_block = (
        per_month.join(blocks.select("month", "block"), "month")
        .groupBy("col", "key", "block")
        .agg(F.sum("s_m").alias("s_b"), F.sum("n_m").alias("n_b"))
    )
    past = Window.partitionBy("col", "key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = per_block.select(
        "col", "key", "block", F.sum("s_b").over(past).alias("s"), F.sum("n_b").over(past).alias("n")
    )
    totals = per_month.groupBy("col", "key").agg(
        F.lit(-1).alias("block"), F.sum("s_m").alias("s"), F.sum("n_m").alias("n")
    )
    return BlockTE(_written(earlier.unionByName(totals)), blocks, prior, any_valid)


def with_blocks(df: DataFrame, blocks: DataFrame, month: str = "time_key") -> DataFrame:
    """Attach (__blk, __valid) of each row's month (null for months outside)."""
    b = blocks.select(
        F.col("month").alias("__bm"), F.col("block").alias("__blk"), F.col("valid").alias("__valid")
    )
    return df.join(b, F.col(month) == F.col("__bm"), "left").drop("__bm")


def apply_block_te(
    df: DataFrame, model: BlockTE, key: str, out: str | None = None, split: str = SPLIT,
) -> DataFrame:
    """Needs the ``__blk``/``__valid`` columns of :func:`with_blocks`."""
    out = out or f"te_{key}"
    blk = F.when(_is_train(split), F.col("__blk")).otherwise(F.lit(-1))
    joined = _lookup(df, model.table, key, blk, "block")
    value = _block_value(model, F.col("__s"), F.col("__n"), split)
    return joined.withColumn(out, value).drop("__key", "__block", "__s", "__n")


def _block_value(model: BlockTE, s: Column, n: Column, split: str) -> Column:
    prior = F.lit(model.prior)
    mean = F.coalesce(s / n, prior)
    if model.any_valid:
        train_value = F.when(F.col("__valid"), mean)
    else:  # no block has any past: every train row gets the prior
        train_value = prior
    return F.when(_is_train(split), train_value).otherwise(mean).cast("double")


def block_target_encode(df, keys, target=TARGET, month="time_key", n_blocks=5,
                        min_train_gap=1, split=SPLIT, blocks=None):
    keys = _as_list(keys)
    model = fit_block_te(df, keys, target, month, n_blocks, min_train_gap, split, blocks)
    out = with_blocks(df, model.blocks, month)
    for key in keys:
        out = apply_block_te(out, model, key, None, split)
    return out.drop("__blk", "__valid")


# --------------------------------------------------------------------------
# E6 past default rate
# --------------------------------------------------------------------------


@dataclass
class PastRate:
    table: DataFrame  # (col, key, month, rate); month = -1 holds the test-row rate
    global_rate: dict  # col -> global train rate


def fit_past_rate(
    df: DataFrame, keys, target: str = TARGET, month: str = "time_key", split: str = SPLIT
) -> PastRate:
    """E6 per key and month: Σy/n over the key's strictly earlier months.

    Test rows get each key's rate over train months before the last train
    month; keys with no such history fall back to the global train rate.
    All key columns share one aggregation and one small stats collect.
    """
    keys = _as_list(keys)
    long = _long_keys(
        df.filter(_is_train(split)), keys, [F.col(month).alias("month"), _dbl(target).alias("__y")]
    )
    return past_rate_from_sums(
        long.groupBy("col", "key", "month").agg(F.sum("__y").alias("s"), F.count(F.lit(1)).alias("n")), keys
    )


def past_rate_from_sums(sums: DataFrame, keys: list[str]) -> PastRate:
    """The fit of :func:`fit_past_rate` from sums and counts per (col, key, month)."""
    from riskframe.plans.common import forget

    g = _written(sums)  # three consumers: stats collect, running window, test-rate aggregate
    stats = {
        r["col"]: r for r in g.groupBy("col").agg(
            F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("month").alias("last")
        ).collect()
    }
    global_rate = {c: (float(stats[c]["s"]) / max(int(stats[c]["n"]), 1) if c in stats else 0.0) for c in keys}
    past = Window.partitionBy("col", "key").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    train_rate = g.select(
        "col", "key", "month", (F.sum("s").over(past) / F.sum("n").over(past)).alias("rate")
    )
    last = F.create_map(*[x for c in stats for x in (F.lit(c), F.lit(stats[c]["last"]))]) if stats else None
    if last is None:
        rates = _written(train_rate)
        forget(g)
        return PastRate(rates, global_rate)
    test_rate = (
        g.filter(F.col("month") < last[F.col("col")])
        .groupBy("col", "key")
        .agg(F.lit(-1).cast(g.schema["month"].dataType).alias("month"),
             (F.sum("s") / F.sum("n")).alias("rate"))
    )
    rates = _written(train_rate.unionByName(test_rate))
    forget(g)
    return PastRate(rates, global_rate)


def apply_past_rate(
    df: DataFrame, model: PastRate, key: str, out: str | None = None,
    month: str = "time_key", split: str = SPLIT,
) -> DataFrame:
    out = out or f"hist_rate_{key}"
    m = F.when(_is_train(split), F.col(month)).otherwise(F.lit(-1))
    joined = _lookup(df, model.table, key, m, "month")
    value = F.coalesce(F.col("__rate"), F.lit(model.global_rate[key]))
    return joined.withColumn(out, value).drop("__key", "__month", "__rate")


def past_rate(df, keys, target=TARGET, month="time_key", split=SPLIT):
    keys = _as_list(keys)
    model = fit_past_rate(df, keys, target, month, split)
    for key in keys:
        df = apply_past_rate(df, model, key, None, month, split)
    return df


# --------------------------------------------------------------------------
# One lookup for all encoders of a key column
# --------------------------------------------------------------------------


def combine_fits(freq: DataFrame | None = None, counts: DataFrame | None = None,
                 te: KFoldTE | BlockTE | None = None, past: PastRate | None = None) -> DataFrame:
    """All fitted tables as one: (col, key, freq, cnt, te, past).

    Means per fold or block and rates per month become maps of a key's few slots,
    so that a key column needs one join for everything that is known of its values.
    """
    def rows(table, kind, slot, a, b=None):
        return table.select("col", "key", F.lit(kind).alias("kind"), slot.cast("int").alias("slot"),
                            F.col(a).cast("double").alias("a"), (F.col(b) if b else F.lit(None)).cast("double").alias("b"))

    none = F.lit(None)
    parts = []
    if freq is not None:
        parts.append(rows(freq, "freq", none, "freq"))
    if counts is not None:
        parts.append(rows(counts, "cnt", none, "n"))
    if te is not None:
        parts.append(rows(te.table, "te", F.col("fold" if isinstance(te, KFoldTE) else "block"), "s", "n"))
    if past is not None:
        parts.append(rows(past.table, "past", F.col("month"), "rate"))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)

    def only(kind, value):
        return F.when(F.col("kind") == kind, value)

    def slots(kind):
        return F.map_from_entries(F.collect_list(only(kind, F.struct("slot", F.struct("a", "b").alias("v"))))).alias(kind)

    return _written(long.groupBy("col", "key").agg(
        F.max(only("freq", F.col("a"))).alias("freq"), F.max(only("cnt", F.col("a"))).alias("cnt"), slots("te"), slots("past")))


# Values sent to all rows at most: of a key column's fitted table, a slot of a map counting as one. A few megabytes.
FEW_VALUES = 100_000


def few_valued(table: DataFrame) -> set[str]:
    """The key columns whose rows in a fitted table hold at most ``FEW_VALUES`` values, by exact count (one job).

    The lookup of any other column deals out the rows by its key. A filter on
    ``col`` says nothing of its rows to the planner, so without this the rows are dealt
    out for the smallest column as soon as the table as a whole is large.
    """
    slots = [F.greatest(F.size(c), F.lit(0)) for c, kind in table.dtypes if kind.startswith("map")]
    held = table.groupBy("col").agg(F.sum(sum(slots, F.lit(1))).alias("n")).collect()  # a row a key column
    return {r["col"] for r in held if r["n"] <= FEW_VALUES}


def apply_fits(df: DataFrame, table: DataFrame, col: str, freq: str | None = None, cnt: str | None = None,
               te: KFoldTE | BlockTE | None = None, past: PastRate | None = None,
               id_col: str = "id", month: str = "time_key", split: str = SPLIT,
               few: bool = False, share: tuple[str, float] | None = None) -> DataFrame:
    """The encoded columns of one key column by one join: ``freq`` and ``cnt`` name the
    outputs of E1 and E2, ``te`` and ``past`` are the models of E3/E5 and E6. Block means
    need the ``__blk``/``__valid`` columns of :func:`with_blocks`. ``few``: the column has
    few values (:func:`few_valued`), so they are sent to all rows. ``share`` names the output
    of E1 that a null has a share in, and that share."""
    t = table.filter(F.col("col") == col).select(*[F.col(c).alias(f"__{c}") for c in ("key", "freq", "cnt", "te", "past")])
    out = df.join(F.broadcast(t) if few else t, F.col(col).cast("string").eqNullSafe(F.col("__key")), "left")
    cols = {}
    if freq:
        cols[freq] = F.col("__freq")
    if share:
        cols[share[0]] = F.when(F.col(col).isNull(), F.lit(share[1])).otherwise(F.col("__freq"))
    if cnt:
        cols[cnt] = F.coalesce(F.col("__cnt"), F.lit(0.0))
    if te is not None:
        kfold = isinstance(te, KFoldTE)
        slot = _fold_slot(te, id_col, split) if kfold else F.when(_is_train(split), F.col("__blk")).otherwise(F.lit(-1))
        e = F.try_element_at("__te", slot.cast("int"))
        cols[f"te_{col}"] = _kfold_value(te, col, e["a"], e["b"]) if kfold else _block_value(te, e["a"], e["b"], split)
    if past is not None:
        slot = F.when(_is_train(split), F.col(month)).otherwise(F.lit(-1))
        cols[f"hist_rate_{col}"] = F.coalesce(F.try_element_at("__past", slot.cast("int"))["a"], F.lit(past.global_rate[col]))
    return out.withColumns(cols).drop("__key", "__freq", "__cnt", "__te", "__past")


# --------------------------------------------------------------------------
# E7 quantile bins, E8/E9 weight of evidence
# --------------------------------------------------------------------------


def fit_quantile_edges_multi(df: DataFrame, cols: list[str], q: int, where: Column | None = None,
                             accuracy: int | None = None) -> dict[str, list[float]]:
    """Sorted distinct quantile edges at 0, 1/q, …, 1 (linear interpolation)
    for several columns in one ranking pass.

    Exact by default through the distributed ranking of ``stats.quantiles``;
    ``accuracy`` switches to ``percentile_approx``.
    """
    from riskframe.operators.stats import quantiles

    src = df if where is None else df.filter(where)
    probs = [i / q for i in range(q + 1)]
    got = quantiles(src.select(*cols), cols, probs, accuracy)
    out = {}
    for c in cols:
        edges: list[float] = []
        for e in got.get(c) or []:
            if not edges or e != edges[-1]:
                edges.append(float(e))
        out[c] = edges
    return out


def fit_quantile_edges(df: DataFrame, col: str, q: int, where: Column | None = None,
                       accuracy: int | None = None) -> list[float]:
    return fit_quantile_edges_multi(df, [col], q, where, accuracy)[col]


def bin_index(x: Column, edges: list[float]) -> Column:
    """Right-closed bin id (0-based) with the lowest edge included; values
    outside [edges[0], edges[-1]] and nulls → null."""
    if len(edges) < 2:
        return F.lit(None).cast("int")
    expr = None
    for i, e in enumerate(edges[1:]):
        cond = x <= F.lit(e)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return F.when((x >= F.lit(edges[0])) & (x <= F.lit(edges[-1])), expr).cast("int")


def quantile_bin(df: DataFrame, col: str, q: int = 20, out: str | None = None,
                 accuracy: int | None = None) -> DataFrame:
    """E7 equal-frequency bins over all rows, duplicate edges dropped."""
    edges = fit_quantile_edges(df, col, q, accuracy=accuracy)
    return df.withColumn(out or f"{col}_bin", bin_index(F.col(col).cast("double"), edges))


@dataclass
class WOE:
    edges: list[float]
    weights: list[float]  # one per bin; empty → every row gets 0.0


def fit_woe(
    df: DataFrame, col: str, target: str = TARGET, q: int = 10, style: str = "good_bad",
    split: str = SPLIT, accuracy: int | None = None,
) -> WOE:
    """E8/E9 weight of evidence of one column, see ``fit_woe_multi``."""
    return fit_woe_multi(df, [col], target, q, style, split, accuracy)[col]


def _woe_weights(style: str, bins: int, stats: dict[int, tuple[float, float]]) -> list[float]:
    """A weight per bin from its (bad, good) counts."""
    import math

    bad_total = sum(v[0] for v in stats.values())
    good_total = sum(v[1] for v in stats.values())
    weights = []
    for b in range(bins):
        bad, good = stats.get(b, (0.0, 0.0))
        if b not in stats and style == "good_bad":
            weights.append(0.0)  # an empty bin is never looked up in this style
            continue
        if style == "good_bad":
            v = math.log(((good + 0.5) / (good_total + 0.5)) / ((bad + 0.5) / (bad_total + 0.5)))
        else:
            v = math.log(((bad + 0.5) / (bad_total + 1.0)) / ((good + 0.5) / (good_total + 1.0)))
        weights.append(v if math.isfinite(v) else 0.0)
    return weights


def apply_woe(df: DataFrame, model: WOE, col: str, out: str | None = None) -> DataFrame:
    out = out or f"woe_{col}"
    if not model.weights:
        return df.withColumn(out, F.lit(0.0))
    b = bin_index(F.col(col).cast("double"), model.edges)
    w = F.array(*[F.lit(v) for v in model.weights])
    return df.withColumn(out, F.coalesce(F.get(w, b), F.lit(0.0)))


def woe_encode(df, col, target=TARGET, q=10, style="good_bad", out=None, split=SPLIT, accuracy=None):
    return apply_woe(df, fit_woe(df, col, target, q, style, split, accuracy), col, out)


def fit_woe_multi(df: DataFrame, cols: list[str], target: str = TARGET, q: int = 10, style: str = "good_bad",
                  split: str = SPLIT, accuracy: int | None = None) -> dict[str, WOE]:
    """E8/E9 weight of evidence over train-only quantile bins, all columns in one ranking pass and one aggregate.

    ``good_bad``: ln(((g+.5)/(G+.5)) / ((b+.5)/(B+.5))); needs >= 2 bins.
    ``bad_good``: ln(((b+.5)/(B+1)) / ((g+.5)/(G+1))); one bin is enough, and the
    train row count caps the bins. Rows are unpivoted to (column, bin) and counted
    before the shuffle; at most ``q`` rows a column reach the driver, which the
    encoders apply as literal arrays, without a join.
    """
    if style not in ("good_bad", "bad_good"):
        raise ValueError(style)
    train_cond = _is_train(split)
    q_eff = q
    if style == "bad_good":
        q_eff = max(1, min(q, df.filter(train_cond).count()))
    edges = fit_quantile_edges_multi(df, cols, q_eff, where=train_cond, accuracy=accuracy)
    usable = [c for c in cols if len(edges[c]) >= (3 if style == "good_bad" else 2)]
    stats: dict[str, dict[int, tuple[float, float]]] = {c: {} for c in usable}
    if usable:
        cells = F.array(*[F.struct(F.lit(c).alias("c"), bin_index(F.col(c).cast("double"), edges[c]).alias("b")) for c in usable])
        rows = df.filter(train_cond).select(_dbl(target).alias("y"), F.explode(cells).alias("cell")).filter(F.col("cell.b").isNotNull())
        counted = rows.groupBy("cell.c", "cell.b").agg(F.sum("y").alias("bad"), F.count(F.lit(1)).alias("n"))
        for r in counted.collect():  # a row per column and bin
            stats[r["c"]][r["b"]] = (float(r["bad"]), float(r["n"] - r["bad"]))
    return {c: WOE(edges[c], _woe_weights(style, len(edges[c]) - 1, stats[c]) if c in stats else []) for c in cols}


# --------------------------------------------------------------------------
# E10 cardinality / high-cardinality downgrade
# --------------------------------------------------------------------------


def cardinality(df: DataFrame, cols: list[str]) -> DataFrame:
    """G4 distinct values per column, a null counting as one value: (cat_col, nunique).

    One exact aggregation for all columns: values are unpivoted as text and
    counted per (column, value), combined before the shuffle, so no row is
    expanded by the shuffle and no task holds a column's values.
    """
    if not cols:
        raise ValueError("no columns")
    rows = df.select(*[F.struct(F.col(c).cast("string").alias("key")).alias(c) for c in cols]).unpivot([], cols, "cat_col", "s")
    values = rows.groupBy("cat_col", F.col("s.key").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return values.groupBy("cat_col").agg(F.count(F.lit(1)).cast("bigint").alias("nunique"))


def high_cardinality(card: DataFrame, threshold: int) -> list[str]:
    return [r["cat_col"] for r in card.filter(F.col("nunique") > threshold).collect()]


def high_cardinality_columns(df: DataFrame, cols: list[str], threshold: int) -> list[str]:
    """E10 columns with more than ``threshold`` distinct values (null counted), by exact count."""
    if not cols:
        return []
    high = set(high_cardinality(cardinality(df, cols), threshold))
    return [c for c in cols if c in high]
