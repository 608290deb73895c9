"""Unsupervised summaries of the sibling columns n0...n14: principal components and clusters.

Both are fitted over train and test rows together, since no target is involved.
A null takes its column's mean, and columns are scaled to unit population variance;
a constant or wholly null column counts as zero. What reaches the driver is d means, d
scales, d x d cross products or k x d centres, never rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Scale:
    cols: list[str]
    mean: list[float]
    std: list[float]  # 0 for a constant column

    def column(self, k: int) -> Column:
        if not self.std[k]:
            return F.lit(0.0)
        return (F.coalesce(F.col(self.cols[k]).cast("double"), F.lit(self.mean[k])) - F.lit(self.mean[k])) / F.lit(self.std[k])

    def vector(self) -> Column:
        return F.array(*[self.column(k) for k in range(len(self.cols))])


@dataclass
class Components:
    scale: Scale
    gram: np.ndarray  # mean cross products of the scaled columns
    variance: np.ndarray  # descending
    loadings: np.ndarray  # one column a component


def fit_scale(df: DataFrame, cols: list[str]) -> Scale:
    """Means over present values, scales over all rows after filling; one aggregate for all columns."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for k, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{k}"), F.avg(x).alias(f"m{k}"), F.var_pop(x).alias(f"v{k}")]
    r = df.agg(*aggs).first()
    mean = [float(r[f"m{k}"] or 0.0) for k in range(len(cols))]
    std = [float(np.sqrt((r[f"v{k}"] or 0.0) * r[f"n{k}"] / max(1, r["n"]))) for k in range(len(cols))]
    # what is left of a constant column's variance after rounding is no variance
    return Scale(list(cols), mean, [s if s > 1e-12 * max(1.0, abs(m)) else 0.0 for s, m in zip(std, mean)])


def fit_gram(df: DataFrame, scale: Scale) -> np.ndarray:
    """Mean of z_i * z_j over all rows, for all i <= j in one aggregate; zeros for an empty table."""
    d = len(scale.cols)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    z = df.select(*[scale.column(k).alias(f"z{k}") for k in range(d)])
    r = z.agg(*[F.avg(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"g{i}_{j}") for i, j in pairs]).first()
    gram = np.zeros((d, d))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = r[f"g{i}_{j}"] or 0.0
    return gram


def fit_components(df: DataFrame, cols: list[str]) -> Components:
    """Two scans (scales, then cross products) and a d x d eigen solve.

    A component's sign is fixed by its largest loading, which is positive (the first of equals).
    """
    scale = fit_scale(df, cols)
    gram = fit_gram(df, scale)
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(-values, kind="stable")
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    top = np.argmax(np.round(np.abs(vectors), 9), axis=0)
    return Components(scale, gram, values, vectors * np.where(vectors[top, range(len(cols))] < 0, -1.0, 1.0))


def add_components(df: DataFrame, fit: Components, n: int, prefix: str = "n_pc") -> DataFrame:
    """Add ``<prefix>1..n`` in one projection; no shuffle."""
    d = len(fit.scale.cols)
    if not 1 <= n <= d:
        raise ValueError(f"between 1 and {d} components, not {n}")
    z = [fit.scale.column(k) for k in range(d)]
    return df.withColumns({f"{prefix}{c + 1}": sum((F.lit(float(fit.loadings[k, c])) * z[k] for k in range(1, d)), F.lit(float(fit.loadings[0, c])) * z[0]) for c in range(n)})


@dataclass
class Clusters:
    scale: Scale
    centres: np.ndarray
    rounds: int


def _nearest(scale: Scale, centres: np.ndarray) -> Column:
    """Number of the nearest centre, the smallest of equals, and its squared distance."""
    z = [scale.column(k) for k in range(len(scale.cols))]
    far = F.array(*[F.struct(sum((F.pow(x - F.lit(float(c)), F.lit(2.0)) for x, c in zip(z[1:], centre[1:])), F.pow(z[0] - F.lit(float(centre[0])), F.lit(2.0))).alias("d"), F.lit(k).alias("k")) for k, centre in enumerate(centres)])
    return F.array_min(far)


def fit_clusters(df: DataFrame, cols: list[str], id_col: str, k: int, max_rounds: int = 100, tol: float = 1e-6) -> Clusters:
    """Lloyd rounds from the k distinct vectors with the least hash of an id, one aggregate a round.

    Rounds end when no centre moves by more than ``tol``, or after ``max_rounds``. Fewer distinct
    vectors than ``k`` give as many clusters; an empty cluster keeps its centre; an empty
    table is refused.
    """
    scale = fit_scale(df, cols)
    d = len(cols)
    seeds = df.select(scale.vector().alias("z"), F.md5(F.col(id_col).cast("string")).alias("h")).groupBy("z").agg(F.min("h").alias("h")).orderBy("h").limit(k).collect()
    if not seeds:
        raise ValueError("no rows to cluster")
    centres = np.array([r["z"] for r in seeds])
    rounds = 0
    while rounds < max_rounds:
        rounds += 1
        near = df.select(_nearest(scale, centres)["k"].alias("k"), *[scale.column(i).alias(f"z{i}") for i in range(d)])
        new = centres.copy()
        for r in near.groupBy("k").agg(*[F.avg(f"z{i}").alias(f"z{i}") for i in range(d)]).collect():  # k rows
            new[r["k"]] = [r[f"z{i}"] for i in range(d)]
        moved = float(np.abs(new - centres).max())
        centres = new
        if moved <= tol:
            break
    return Clusters(scale, centres, rounds)


def add_cluster(df: DataFrame, fit: Clusters, out: str = "n_cluster") -> DataFrame:
    """Add the nearest centre's number and ``<out>_dist``, its distance."""
    near = _nearest(fit.scale, fit.centres)
    return df.withColumn(out, near["k"]).withColumn(f"{out}_dist", F.sqrt(near["d"]))
