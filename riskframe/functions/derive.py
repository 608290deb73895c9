"""Derived numeric columns as Column expressions.

Ratios use ``try_divide`` (ANSI mode is on: a zero divisor gives null rather
than an error; the later inf→null step treats both alike). Row statistics over
the sibling columns n0…n14 are array higher-order functions — one pass per
row inside codegen, no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

N_COLS = [f"n{i}" for i in range(15)]


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num, den, add: float = 1.0) -> Column:
    """num / (den + add)."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double") + F.lit(add))


# Ratio features: output name -> (numerator, denominator, added constant).
# Fixed definitions of the modelled pipeline (feature versions in brackets).
RATIOS = {
    "loan_income_ratio": ("loanAmnt", "annualIncome", 1.0),  # v1 v2 nb
    "install_to_income": ("installment", "annualIncome", 1.0),  # v1 v2
    "inst_to_loan": ("installment", "loanAmnt", 1.0),  # v2 (v3 calls it pay_ratio)
    "pay_ratio": ("installment", "loanAmnt", 1.0),  # v3
    "revol_per_acc": ("revolBal", "totalAcc", 1.0),  # v2
    "revol_bal_per_acc": ("revolBal", "openAcc", 1.0),  # nb
    "revol_income": ("revolBal", "annualIncome", 1.0),  # v3
    "open_ratio": ("openAcc", "totalAcc", 1.0),  # v3 (nb: open_to_total)
    "open_to_total": ("openAcc", "totalAcc", 1.0),  # nb
}


def fico_mean(lo="ficoRangeLow", hi="ficoRangeHigh") -> Column:
    return (col(lo) + col(hi)) / F.lit(2.0)


def fico_range(lo="ficoRangeLow", hi="ficoRangeHigh") -> Column:
    return col(hi) - col(lo)


def installment_income_ratio(inst="installment", income="annualIncome") -> Column:
    """N5 installment / (monthly income + 1e-6)."""
    return F.try_divide(col(inst).cast("double"), col(income) / F.lit(12.0) + F.lit(1e-6))


def ir_x_term(rate="interestRate", term_mon="term_mon") -> Column:
    return col(rate) * col(term_mon)


def log1p_clip(x) -> Column:
    """N12 ln(1 + max(x, 0)); null stays null."""
    c = col(x).cast("double")
    return F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(0.0))))


def clip(x, lo: float | None, hi: float | None) -> Column:
    """Clip to [lo, hi]; null stays null and NaN becomes null (N13 winsorise applies fitted bounds)."""
    c = F.nullif(col(x).cast("double"), F.lit(float("nan")))
    if lo is not None:
        c = F.when(c < F.lit(lo), F.lit(lo)).otherwise(c)
    if hi is not None:
        c = F.when(c > F.lit(hi), F.lit(hi)).otherwise(c)
    return c


# --------------------------------------------------------------------------
# Row statistics over n0..n14 (N15-N19)
# --------------------------------------------------------------------------


def n_array(cols: list[str], nulls: str = "zero") -> Column:
    """The n-columns as one array, NaN as null; ``nulls='zero'`` fills, ``'skip'`` drops them."""
    arr = F.array(*[F.nullif(col(c).cast("double"), F.lit(float("nan"))) for c in cols])
    if nulls == "zero":
        return F.transform(arr, lambda x: F.coalesce(x, F.lit(0.0)))
    if nulls == "skip":
        return F.filter(arr, lambda x: x.isNotNull())
    raise ValueError(nulls)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def row_stats(a: Column) -> dict[str, Column]:
    """N15 sum, mean, max, sample std (ddof 1), count of positives."""
    n = F.size(a)
    s = _sum(a)
    mean = F.when(n > 0, s / n)
    sq = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    return {
        "n_sum": s,
        "n_mean": mean,
        "n_max": F.array_max(a),
        "n_std": F.when(n > 1, F.sqrt(sq / (n - 1))),
        "n_nonzero": F.size(F.filter(a, lambda x: x > 0)).cast("double"),
    }


def column_stats(cols: list[str], nulls: str = "zero") -> dict[str, Column]:
    """``row_stats(n_array(cols, nulls))`` as plain arithmetic over the columns, in the same order.

    The array's higher-order functions are interpreted, and the mean inside the
    squares is evaluated anew for every element.
    """
    if nulls not in ("zero", "skip"):
        raise ValueError(nulls)
    raw = [F.nullif(col(c).cast("double"), F.lit(float("nan"))) for c in cols]
    held = [F.coalesce(x, F.lit(0.0)) for x in raw]
    if nulls == "zero":
        raw = held

    def added(terms: list[Column], zero) -> Column:
        total = F.lit(zero)
        for t in terms:
            total = total + t
        return total

    n = F.lit(len(cols)) if nulls == "zero" else added([x.isNotNull().cast("int") for x in raw], 0)
    s = added(held, 0.0)
    mean = F.when(n > 0, s / n)
    sq = added([F.coalesce((x - mean) * (x - mean), F.lit(0.0)) for x in raw], 0.0)
    return {
        "n_sum": s,
        "n_mean": mean,
        "n_max": F.greatest(*raw) if len(raw) > 1 else raw[0],
        "n_std": F.when(n > 1, F.sqrt(sq / F.nullif(n - 1, F.lit(0)))),
        "n_nonzero": added([F.when(x > 0, 1).otherwise(0) for x in raw], 0).cast("double"),
    }


def row_stats_ext(a: Column) -> dict[str, Column]:
    """N17 share of positives, N18 sum of the three largest values."""
    n = F.size(a)
    pos = F.size(F.filter(a, lambda x: x > 0)).cast("double")
    return {
        "n_pos_rate": F.when(n > 0, pos / n),
        "n_top3": _sum(F.slice(F.sort_array(a, asc=False), 1, 3)),
    }


def row_quantile(a: Column, p: float) -> Column:
    """N16 linear-interpolated quantile of the non-null values in a row."""
    s = F.array_sort(F.filter(a, lambda x: x.isNotNull()))
    n = F.size(s)
    pos = (n - 1) * F.lit(p)
    lo = F.floor(pos).cast("int")
    frac = pos - lo
    a_lo = F.element_at(s, lo + 1)
    a_hi = F.element_at(s, F.least(lo + 2, n))
    return F.when(n > 0, a_lo + (a_hi - a_lo) * frac)


def row_entropy(cols: list[str], mins: dict[str, float], maxs: dict[str, float]) -> Column:
    """N19 mean Bernoulli entropy of per-column min-max scaled values.

    ``mins``/``maxs`` come from one aggregate over the zero-filled columns.
    """
    terms = []
    for c in cols:
        x = F.coalesce(col(c).cast("double"), F.lit(0.0))
        z = (x - F.lit(mins[c])) / F.lit(maxs[c] - mins[c] + 1e-6)
        z = F.least(F.greatest(z, F.lit(1e-6)), F.lit(1 - 1e-6))
        terms.append(-(z * F.log(z) + (1 - z) * F.log(1 - z)))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total / F.lit(float(len(cols)))
