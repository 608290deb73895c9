"""Blending of model scores.

Input is the long prediction table ``(run, split, id, y, pred)``. Aligning is
one conditional aggregation by (split, id) — the N-way inner join of the
per-run files without N shuffles. Strategies that need ranks use the bucketed
``metrics.score_table`` (no global sort). Strategies that need a search
(weight grid, greedy selection) evaluate all candidates of one round in ONE
job by exploding candidate weights next to each row and grouping by
candidate; the driver only sees one AUC per candidate.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.operators import metrics


# ------------------------------------------------------------------ J1 align


def align(preds: DataFrame, runs: list[str]) -> DataFrame:
    """J1 wide table (split, id, y, <run>...) with ids present in every run.

    Rows whose target differs between runs raise at evaluation time (D14:
    the target must agree; it is not silently taken from the first run), and so
    do ids that a run holds twice (D19).
    """
    rows = preds.filter(F.col("run").isin(runs))
    held = [F.sum((F.col("run") == r).cast("int")).alias(f"__n_{r}") for r in runs]
    g = rows.groupBy("split", "id").agg(
        *[F.max(F.when(F.col("run") == r, F.col("pred"))).alias(r) for r in runs], *held,
        F.min("y").alias("y"), F.max("y").alias("__ymax"),
    )
    twice = F.lit(False)
    for r in runs:
        twice = twice | (F.col(f"__n_{r}") > 1)
    differs = ~F.col("y").eqNullSafe(F.col("__ymax"))
    checked = g.withColumn(
        "y", F.when(twice, F.raise_error(F.lit("an id is repeated in a run")).cast("int"))
        .when(differs, F.raise_error(F.lit("target differs between runs")).cast("int")).otherwise(F.col("y")))
    complete = F.lit(True)
    for r in runs:
        complete = complete & (F.col(f"__n_{r}") > 0)
    return checked.filter(complete).select("split", "id", "y", *runs)


def align_report(preds: DataFrame, runs: list[str]) -> DataFrame:
    """D14 how many (split, id) rows each run has and how many the inner join drops."""
    per = preds.groupBy("split", "id").agg(F.count_distinct("run").alias("nr"))
    return per.groupBy("split").agg(
        F.count(F.lit(1)).alias("ids"),
        F.sum(F.when(F.col("nr") < len(runs), 1).otherwise(0)).alias("dropped"),
    )


# ------------------------------------------------------------------ B1-B3


def blend_mean(wide: DataFrame, runs: list[str]) -> DataFrame:
    """B1 plain average of the run scores."""
    s = sum((F.col(r) for r in runs[1:]), F.col(runs[0]))
    return wide.select("split", "id", "y", (s / F.lit(float(len(runs)))).alias("pred"))


def _logit(c):
    p = F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def blend_logit_mean(wide: DataFrame, runs: list[str]) -> DataFrame:
    """B2 sigmoid of the mean logit (scores clipped to [1e-6, 1-1e-6])."""
    s = sum((_logit(F.col(r)) for r in runs[1:]), _logit(F.col(runs[0])))
    m = s / F.lit(float(len(runs)))
    return wide.select("split", "id", "y", (1 / (1 + F.exp(-m))).alias("pred"))


def ranks_long(wide: DataFrame, runs: list[str], by=("split",)) -> DataFrame:
    """Average rank of every run's score within ``by`` → (by…, id, run, rank)."""
    long = wide.select(*by, "id", *runs).unpivot([*by, "id"], runs, "run", "pred")
    return metrics.avg_rank(long, "pred", by=[*by, "run"], out="rank").drop("pred")


def blend_rank_mean(wide: DataFrame, runs: list[str]) -> DataFrame:
    """B3 mean of per-run average ranks, min-max scaled within each split."""
    return _scaled_mean(ranks_long(wide, runs), wide)


def _scaled_mean(r: DataFrame, wide: DataFrame) -> DataFrame:
    """B3 from the runs' ranks."""
    from riskframe.plans.common import materialize

    # written once: the bounds and the scaled scores both read it
    m = materialize(r.groupBy("split", "id").agg(F.avg("rank").alias("pred")))
    m = metrics.minmax_normalize(m, "pred", by=["split"])
    return m.join(wide.select("split", "id", "y"), ["split", "id"])


# ------------------------------------------------------------------ G10 / B8


def spearman_matrix(wide: DataFrame, runs: list[str], split: str = "oof") -> DataFrame:
    """G10 Pearson correlation of average ranks for every pair, one aggregate.

    Returns (run_a, run_b, rho) for all ordered pairs.
    """
    return _correlations(ranks_long(wide.filter(F.col("split") == split), runs), runs)


def _correlations(r: DataFrame, runs: list[str]) -> DataFrame:
    """G10 from the ranks of one split."""
    rw = r.groupBy("id").agg(*[F.max(F.when(F.col("run") == x, F.col("rank"))).alias(x) for x in runs])
    cells = []
    for a in runs:
        for b in runs:
            rho = F.lit(1.0) if a == b else F.corr(a, b)
            cells.append(F.struct(F.lit(a).alias("run_a"), F.lit(b).alias("run_b"), rho.alias("rho")).alias(f"{a}|{b}"))
    one_row = rw.agg(*cells)
    return one_row.unpivot([], one_row.columns, "pair", "c").select("c.run_a", "c.run_b", "c.rho")


def redundancy(rho: dict, aucs: dict, runs: list[str], threshold: float = 0.985, least: int = 3) -> tuple[list[str], list[str]]:
    """B8 (kept, dropped): of every set of near-identical runs the best one stays.

    ``rho``: (run, run) → rank correlation. The first run not yet assigned draws
    in all later unassigned ones it correlates with at ``threshold`` or more; of
    such a set the run with the best AUC stays (no AUC counts as 0, the earlier
    run wins ties). If fewer than ``least`` would stay, all do.
    """
    waiting, winners = list(runs), []
    while waiting:
        head = waiting[0]
        drawn = [r for r in waiting if r == head or (rho.get((head, r)) or 0.0) >= threshold]
        waiting = [r for r in waiting if r not in drawn]
        winners.append(min(drawn, key=lambda r: -(aucs.get(r) or 0.0)))
    if len(winners) < least:
        return list(runs), []
    return winners, [r for r in runs if r not in winners]


# ------------------------------------------------------------------ B6 weight search

BOUND_BINS = 2048
FINE_BINS = 1 << 16


def simplex_grid(m: int, steps: int) -> list[tuple[float, ...]]:
    """All weight vectors with entries k/steps summing to 1 (lexicographic),
    each made directly: a vector is a choice of m - 1 dividers among
    steps + m - 1 places."""
    out = []
    for dividers in itertools.combinations(range(steps + m - 1), m - 1):
        ends = (-1, *dividers, steps + m - 1)
        out.append(tuple((ends[i + 1] - ends[i] - 1) / steps for i in range(m)))
    return out


def grid_auc(wide: DataFrame, runs: list[str], weights: list[tuple[float, ...]], split: str = "oof", above: float | None = None) -> DataFrame:
    """Best weight vectors by AUC of Σ w_i·score_i: (vec, w_<run>..., auc) of the finalists.

    First every vector's scores are counted in ``BOUND_BINS`` bins, combined before
    the shuffle, so vectors x bins rows move, not vectors x rows. Pairs in
    different bins are ordered for sure, pairs in one bin either way: that bounds
    each AUC from both sides. Only vectors whose upper bound reaches the best
    lower bound can win; if several do, they are counted in ``FINE_BINS`` bins, and
    the AUC of those still in reach is computed exactly. ``above``: vectors that can't
    have a higher AUC than this don't matter either (none may be left).
    """
    spark = wide.sparkSession
    vectors = spark.createDataFrame(
        [(i, [float(w) for w in ws]) for i, ws in enumerate(weights)], "vec int, w array<double>")
    rows = wide.filter(F.col("split") == split).select("y", F.array(*[F.col(r).cast("double") for r in runs]).alias("x"))

    def scored(ids: list[int]) -> DataFrame:
        vs = F.array(*[F.struct(F.lit(i).alias("vec"), F.array(*[F.lit(float(w)) for w in weights[i]]).alias("w")) for i in ids])
        each = rows.select("y", "x", F.explode(vs).alias("v"))
        p = F.lit(0.0)
        for j in range(len(runs)):
            p = p + F.col("v.w")[j] * F.col("x")[j]
        return each.select(F.col("v.vec").alias("vec"), "y", p.alias("p"))

    finalists = list(range(len(weights)))
    if len(weights) > 1 or above is not None:
        finalists = _in_reach(scored, finalists, _bounds(rows, F.col("x")), above)
    if not finalists:
        return spark.createDataFrame([], "vec int, " + "".join(f"w_{r} double, " for r in runs) + "auc double")
    a = metrics.auc(scored(finalists), "p", "y", by=["vec"])
    return a.join(vectors, "vec").select("vec", *[F.col("w")[j].alias(f"w_{r}") for j, r in enumerate(runs)], "auc")


def _bounds(rows: DataFrame, x: Column) -> tuple[float | None, float | None]:
    """The least and the greatest finite score in an array column."""
    finite = F.filter(x, metrics._finite)
    return tuple(rows.agg(F.min(F.array_min(finite)), F.max(F.array_max(finite))).first())


def _in_reach(scored: Callable[[list[int]], DataFrame], points: list[int], bounds: tuple[float | None, float | None], above: float | None, key: str = "vec") -> list[int]:
    """The points whose AUC may be the best, and more than ``above``, by their counts per bin.

    ``scored``: the rows ``key, y, p`` of some points. Coarse bins first, since those
    are counted for every point; fine ones for the points that the coarse ones leave.
    """
    lo, hi = bounds
    for bins in (BOUND_BINS, FINE_BINS):
        width = (hi - lo) / bins if lo is not None and hi > lo else 1.0
        at = F.greatest(F.lit(0), F.least(F.lit(bins), F.floor((F.col("p") - F.lit(lo or 0.0)) / F.lit(width)))).alias("bin")
        y = F.col("y").cast("double")
        counts = scored(points).filter(metrics._finite(y) & metrics._finite(F.col("p"))).groupBy(key, at).agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n"))
        below = Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # a row per bin
        neg = F.col("n") - F.col("pos")
        found = counts.withColumn("neg", neg).withColumn("nb", F.coalesce(F.sum("neg").over(below), F.lit(0.0))).groupBy(key).agg(
            F.sum(F.col("pos") * F.col("nb")).alias("low"), F.sum(F.col("pos") * (F.col("nb") + F.col("neg"))).alias("high"),
            (F.sum("pos") * F.sum("neg")).alias("pairs")).collect()
        best = max((r["low"] for r in found), default=0.0)
        points = sorted(r[key] for r in found if r["high"] >= best and (above is None or r["high"] > above * r["pairs"]))
        if len(points) < 2:
            break
    return points


def refine_weights(wide: DataFrame, runs: list[str], start: tuple[float, ...], steps=(8, 16), split: str = "oof", start_auc: float | None = None) -> list[tuple[int, tuple[float, ...], float]]:
    """B6 further rounds on finer grids: at each step 1/s the vectors that move s-th
    parts of the weight from one run to another around the best so far, until none
    gains. M (M - 1) vectors a round, whatever M. ``start_auc``: the start's AUC, if it
    is known. Returns [(s, weights, auc)]."""
    now = tuple(start)
    auc = _best_of(wide, runs, [now], split)[1] if start_auc is None else start_auc
    out = []
    for s in steps:
        while True:
            moves = [
                tuple(round(w + (j == b) / s - (j == a) / s, 12) for j, w in enumerate(now))
                for a in range(len(runs)) for b in range(len(runs)) if a != b and now[a] >= 1 / s - 1e-9]
            found, value = _best_of(wide, runs, moves, split, auc)
            if value <= auc + MIN_GAIN:
                break
            now, auc = found, value
        out.append((s, now, auc))
    return out


def _best_of(wide: DataFrame, runs: list[str], points: list, split: str, above: float | None = None) -> tuple[tuple[float, ...] | None, float]:
    """The best of the points and its AUC; None and 0 if none can have more than ``above``."""
    r = grid_auc(wide, runs, points, split, above).orderBy(F.desc_nulls_last("auc"), "vec").first() if points else None
    return (points[r["vec"]], float(r["auc"] or 0.0)) if r else (None, 0.0)


# What counts as a gain in AUC: rounding of its sums stays far below.
MIN_GAIN = 1e-10
GRADIENT_BINS = 4096


def project_simplex(v: np.ndarray) -> np.ndarray:
    """The nearest weights that are at least 0 and sum to 1."""
    u = np.sort(v)[::-1]
    over = (np.cumsum(u) - 1) / np.arange(1, len(u) + 1)
    return np.maximum(v - over[np.flatnonzero(u > over)[-1]], 0.0)


def pair_gradient(wide: DataFrame, runs: list[str], weights, margin: float, bounds: tuple[float, float], split: str = "oof") -> tuple[float, np.ndarray]:
    """Mean squared hinge ``max(0, margin - (p_pos - p_neg))²`` over all pairs, and its gradient in the weights.

    No pair is formed. Rows are summed per class and range of the blended score
    (combined before the shuffle: at most ``2 x GRADIENT_BINS`` rows of M sums reach
    the driver, however many rows there are). The negatives that count for a range of
    positives are those above ``its score - margin``: a running sum from the top.
    Scores stand for the mean of their range, so the loss is that of the ranges.
    """
    m = len(runs)
    x = [F.col(r).cast("double") for r in runs]
    p = sum((F.lit(float(w)) * c for w, c in zip(weights[1:], x[1:])), F.lit(float(weights[0])) * x[0])
    lo, hi = bounds
    width = (hi - lo) / GRADIENT_BINS or 1.0
    rows = wide.filter((F.col("split") == split) & F.col("y").isNotNull()).select("y", p.alias("p"), *[c.alias(f"x{j}") for j, c in enumerate(x)]).filter(F.col("p").isNotNull())
    at = F.greatest(F.lit(0), F.least(F.lit(GRADIENT_BINS - 1), F.floor((F.col("p") - F.lit(lo)) / F.lit(width)))).cast("int")
    cells = rows.groupBy("y", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("p"), *[F.sum(f"x{j}").alias(f"x{j}") for j in range(m)]).collect()
    if not cells:
        return 0.0, np.zeros(m)
    of = {c: sorted((r for r in cells if r["y"] == c), key=lambda r: r["p"] / r["n"]) for c in (0, 1)}
    if not of[0] or not of[1]:
        return 0.0, np.zeros(m)
    n0, n1 = (np.array([float(r["n"]) for r in of[c]]) for c in (0, 1))
    p0, p1 = (np.array([r["p"] / r["n"] for r in of[c]]) for c in (0, 1))
    x0, x1 = (np.array([[r[f"x{j}"] / r["n"] for j in range(m)] for r in of[c]]) for c in (0, 1))
    from_top = lambda v: np.concatenate([np.cumsum(v[::-1], axis=0)[::-1], np.zeros((1, *v.shape[1:]))])
    count, s1, s2 = from_top(n0), from_top(n0 * p0), from_top(n0 * p0 * p0)
    sx, spx = from_top(n0[:, None] * x0), from_top((n0 * p0)[:, None] * x0)
    k = np.searchsorted(p0, p1 - margin, side="right")  # negatives from here on are too close or above
    a = margin - p1
    loss = n1 @ (a * a * count[k] + 2 * a * s1[k] + s2[k])
    slope = n1 @ (a[:, None] * sx[k] + spx[k] - x1 * (a * count[k] + s1[k])[:, None])
    pairs = n0.sum() * n1.sum()
    return float(loss / pairs), 2 * slope / pairs


def gradient_weights(wide: DataFrame, runs: list[str], start, rounds: int = 20, split: str = "oof", start_auc: float | None = None) -> list[tuple[int, tuple[float, ...], float]]:
    """B6 continuous weights: descent on a smooth pair loss, each step accepted by exact AUC.

    A round is one aggregate for the gradient, and one search over points along
    the projected path (eight step lengths and two margins, with ``grid_auc``); the
    best exact AUC is taken if it is a gain. Jobs per round don't grow with
    the number of runs. Never below the start. ``start_auc``: the start's AUC, if it is
    known. Returns [(round, weights, auc)].
    """
    now = tuple(float(w) for w in start)
    auc = _best_of(wide, runs, [now], split)[1] if start_auc is None else start_auc
    out = [(0, now, auc)]
    x = F.array(*[F.col(r).cast("double") for r in runs])
    lo, hi, spread = wide.filter(F.col("split") == split).agg(F.min(F.array_min(x)), F.max(F.array_max(x)), F.stddev_pop(sum((F.col(r) for r in runs[1:]), F.col(runs[0])) / len(runs))).first()
    if lo is None or not hi > lo or not spread:
        return out
    for k in range(1, rounds + 1):
        points = []
        for margin in (0.25 * spread, 1.0 * spread):
            _, g = pair_gradient(wide, runs, now, margin, (lo, hi), split)
            along = g - g.mean()
            if not np.any(along):
                continue
            unit = along / np.max(np.abs(along))
            for t in (0.5, 0.25, 0.12, 0.06, 0.03, 0.015, 0.005, 0.001):
                w = tuple(float(v) for v in np.round(project_simplex(np.array(now) - t * unit), 12))
                if w != now and w not in points:
                    points.append(w)
        found, value = _best_of(wide, runs, points, split, auc)
        if value <= auc + MIN_GAIN:
            break
        now, auc = found, value
        out.append((k, now, auc))
    return out


# ------------------------------------------------------------------ B5 ridge stacking


def stack_ridge(wide: DataFrame, runs: list[str], folds: DataFrame, alpha: float = 2.0, k: int = 5) -> DataFrame:
    """B5 ridge (intercept unpenalised, centred) per fold, closed form.

    ``folds`` is (id, fold) for the oof rows. One aggregate gives, per fold,
    n, Σx, Σy, ΣxxT, Σxy; fold-out statistics are totals minus the fold's.
    The (M+1)-sized solves run on the driver; predictions are one projection
    with the per-fold weights as literals. Test rows get the fold average.
    """
    oof = wide.filter(F.col("split") == "oof").join(folds, "id")
    m = len(runs)
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy")]
    aggs += [F.sum(F.col(r)).alias(f"sx{i}") for i, r in enumerate(runs)]
    aggs += [F.sum(F.col(r) * F.col("y")).alias(f"sxy{i}") for i, r in enumerate(runs)]
    aggs += [F.sum(F.col(a) * F.col(b)).alias(f"sxx{i}_{j}")
             for i, a in enumerate(runs) for j, b in enumerate(runs) if j >= i]
    per = {r["fold"]: r for r in oof.groupBy("fold").agg(*aggs).collect()}

    def vec(r):
        n = float(r["n"])
        sx = np.array([float(r[f"sx{i}"]) for i in range(m)])
        sxy = np.array([float(r[f"sxy{i}"]) for i in range(m)])
        sxx = np.zeros((m, m))
        for i in range(m):
            for j in range(i, m):
                sxx[i, j] = sxx[j, i] = float(r[f"sxx{i}_{j}"])
        return n, float(r["sy"]), sx, sxy, sxx

    stats = {f: vec(r) for f, r in per.items()}
    tot = [sum(s[i] for s in stats.values()) for i in range(5)]
    coefs = {}
    for f, s in stats.items():
        n, sy, sx, sxy, sxx = (tot[i] - s[i] for i in range(5))
        xm, ym = sx / n, sy / n
        gram = sxx - n * np.outer(xm, xm)
        xty = sxy - n * xm * ym
        w = np.linalg.solve(gram + alpha * np.eye(m), xty)
        coefs[f] = (w, ym - float(xm @ w))

    def lin(w, b):
        e = F.lit(float(b))
        for wi, r in zip(w, runs):
            e = e + F.lit(float(wi)) * F.col(r)
        return e

    oof_pred = None
    for f, (w, b) in coefs.items():
        oof_pred = (F.when(F.col("fold") == f, lin(w, b)) if oof_pred is None
                    else oof_pred.when(F.col("fold") == f, lin(w, b)))
    test_pred = sum((lin(w, b) for w, b in coefs.values()), F.lit(0.0)) / F.lit(float(len(coefs)))
    o = oof.select("split", "id", "y", oof_pred.alias("pred"))
    t = wide.filter(F.col("split") == "sub").select("split", "id", "y", test_pred.alias("pred"))
    return o.unionByName(t)


# ------------------------------------------------------------------ B4 LR stacking


def stack_lr(wide: DataFrame, runs: list[str], folds: DataFrame, C: float = 1.0, k: int = 5) -> DataFrame:
    """B4 logistic regression on the run scores, out-of-fold; test = fold mean.

    sklearn's L2 ``C`` (sum loss) maps to Spark's mean-loss ``regParam = 1/(C·n)``;
    no feature standardisation, intercept unpenalised.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from riskframe.plans.common import materialize

    asm = VectorAssembler(inputCols=runs, outputCol="features")
    oof = asm.transform(materialize(wide.filter(F.col("split") == "oof").join(folds, "id")))
    sub = asm.transform(wide.filter(F.col("split") == "sub"))
    p1 = vector_to_array("probability")[1]
    extra = ("rawPrediction", "probability", "prediction")
    held = {r["fold"]: r["count"] for r in oof.groupBy("fold").count().collect()}

    def fit(f: int):
        tr = oof.filter(F.col("fold") != f)
        n = sum(c for x, c in held.items() if x is not None and x != f)
        lr = LogisticRegression(labelCol="y", featuresCol="features", regParam=1.0 / (C * max(n, 1)),
                                elasticNetParam=0.0, standardization=False, maxIter=500)
        return lr.fit(tr.withColumn("y", F.col("y").cast("double")))

    # Many short jobs a fit: side by side the folds keep the cluster busy.
    with ThreadPoolExecutor(k) as pool:
        models = [*pool.map(inheritable_thread_target(wide.sparkSession)(fit), range(k))]
    oof_parts = []
    for f, model in enumerate(models):
        oof_parts.append(model.transform(oof.filter(F.col("fold") == f)).select("split", "id", "y", p1.alias("pred")))
        sub = model.transform(sub).withColumn(f"p{f}", p1).drop(*extra)  # one scan scores all folds
    o = oof_parts[0]
    for p in oof_parts[1:]:
        o = o.unionByName(p)
    mean = sum((F.col(f"p{f}") for f in range(1, k)), F.col("p0")) / k
    return materialize(o.unionByName(sub.select("split", "id", "y", mean.alias("pred"))))


# ------------------------------------------------------------------ B7 greedy


def greedy_selection(wide: DataFrame, runs: list[str], aucs: dict, top_k: int = 6, max_models: int = 8,
                     patience: int = 2, min_gain: float = 5e-5) -> list[tuple[int, str, float]]:
    """B7 forward selection of a mean blend: start from the best run; each
    round scores every candidate addition in one job (candidates ride along
    each row as an exploded array) and adds the best one. As in ``grid_auc``, counts
    per bin bound the AUCs first, and only candidates in reach are scored exactly. Up to ``patience``
    additions in a row may gain less than ``min_gain`` over the best blend so
    far; then, or at ``max_models``, the best prefix is returned. Candidates may
    repeat (weighting by repetition). Returns [(step, run, auc)]."""
    pool = [r for r in sorted(runs, key=lambda r: -(aucs.get(r) or 0.0))][:top_k]
    steps = [(0, pool[0], aucs.get(pool[0]) or 0.0)]
    best, misses = 0, 0  # index of the best prefix's last step
    oof = wide.filter(F.col("split") == "oof")
    bounds = _bounds(oof, F.array(*[F.col(r).cast("double") for r in pool]))
    while len(steps) < max_models and misses < patience:
        chosen = [r for _, r, _ in steps]
        base = sum((F.col(r) for r in chosen[1:]), F.col(chosen[0]))

        def scored(ids: list[int], base=base, n=len(chosen)) -> DataFrame:
            cand = F.array(*[F.struct(F.lit(i).alias("c"), F.col(pool[i]).alias("x")) for i in ids])
            rows = oof.select("y", base.alias("__b"), F.explode(cand).alias("v"))
            return rows.select(F.col("v.c").alias("c"), "y",
                               ((F.col("__b") + F.col("v.x")) / F.lit(n + 1.0)).alias("p"))

        every = [*range(len(pool))]
        reach = _in_reach(scored, every, bounds, None, "c") if len(pool) > 1 else every
        res = metrics.auc(scored(reach or every), "p", "y", by=["c"]).collect()
        top = max(res, key=lambda r: (r["auc"] if r["auc"] is not None else -1.0, -r["c"]))
        steps.append((len(steps), pool[top["c"]], top["auc"] or 0.0))
        if steps[-1][2] - steps[best][2] >= min_gain:
            best, misses = len(steps) - 1, 0
        else:
            misses += 1
    return steps[: best + 1]
