"""Feature pipelines: versions 1, 2, 3 and the notebook.

Plan shape of every version:
1. the loan rows are parsed in one projection and written once (``materialize``);
2. every fit (frequencies, quantiles, winsor bounds, encoder tables, WOE bins)
   is one aggregate job against that written base — never against the growing
   feature frame, so no fit re-runs another fit's joins;
3. the fitted tables are joined back to the narrow rows: key columns of many
   values first, each with one shuffle of the rows that goes before the next,
   then the others, sent to all rows; only then derived columns are added, the
   scalar fits as literals in one projection;
4. imputation (one median job over all floating columns) ends the plan.

A written table goes as soon as nothing reads it any more (``forget``), so on disk are
at a time one shuffle of the rows, the table it reads and the one it makes.

The result is one table with ``is_train``; writing it partitioned by that flag
gives the train/test feature files (``sources.io.write_feature_table``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from riskframe.functions import derive, parse
from riskframe.operators import encode, stats
from riskframe.plans.common import forget, materialize
from riskframe.sources.loans import ID, SPLIT, TARGET, staged_loans, supervised_view

# Fixed settings of the modelled pipeline, per version.
LOW_CARD_AS_CATEGORY = ["grade", "subGrade", "homeOwnership", "verificationStatus", "purpose",
                        "regionCode", "initialListStatus", "applicationType", "policyCode"]
N_COLS = [f"n{i}" for i in range(15)]
FREQ_COLS = ["employmentTitle_cat", "title_cat", "postCode_cat"]


@dataclass
class FeatureConfig:
    version: str = "v3"
    high_card_threshold: int = 300
    time_col: str = "issueDate"
    time_folds: int = 5
    min_train_months: int = 1
    te_folds: int = 5
    te_m: float = 50.0
    woe_bins: int = 10
    quantile_accuracy: int | None = None  # None = exact percentiles
    extra: dict = field(default_factory=dict)


@dataclass
class FeatureTable:
    df: DataFrame
    features: list[str]
    cat_features: list[str]
    meta: dict


def _present(df: DataFrame, *cols: str) -> bool:
    return all(c in df.columns for c in cols)


def _base(loans: DataFrame) -> DataFrame:
    """Row-level parsing shared by all versions (P2: each step only when its
    inputs are present). NaN and ±inf become null before anything reads them (P10)."""
    return _parsed(stats.inf_to_null(loans))


def _parsed(loans: DataFrame) -> DataFrame:
    """The parsed columns that the rows don't have yet."""
    t = loans.schema
    cols = {}
    if "term" in loans.columns:
        cols["term_mon"] = parse.parse_term(F.col("term"), t["term"].dataType)
    if "employmentLength" in loans.columns:
        cols["emp_len_year"] = parse.parse_emp_length(F.col("employmentLength"))
        cols["employmentLength_cat"] = parse.emp_length_token(F.col("employmentLength"))
    if "issueDate" in loans.columns:
        cols["issueDate_dt"] = parse.parse_date(F.col("issueDate"))
    if "earliesCreditLine" in loans.columns:
        cols["earliest_dt"] = parse.parse_date(F.col("earliesCreditLine"))
    if "postCode" in loans.columns:
        cols["postCode_cat"] = parse.postcode3(F.col("postCode"), t["postCode"].dataType)
    for c in ("employmentTitle", "title"):
        if c in loans.columns:
            cols[f"{c}_cat"] = parse.category_copy(F.col(c))
    df = loans.withColumns({c: v for c, v in cols.items() if c not in loans.columns})
    more = {}
    if "term_mon" in df.columns:
        more["term_bin"] = parse.term_bin(F.col("term_mon"))
    if "issueDate_dt" in df.columns:
        more["time_key"] = parse.time_key(F.col("issueDate_dt"))
    if _present(df, "issueDate_dt", "earliest_dt"):
        more["credit_hist_mon"] = parse.credit_history_months(F.col("issueDate_dt"), F.col("earliest_dt"))
    if _present(df, "ficoRangeLow", "ficoRangeHigh"):
        more["fico_mean"] = derive.fico_mean()
    return df.withColumns({c: v for c, v in more.items() if c not in loans.columns})


def _floating(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (DoubleType, FloatType)) and f.name not in exclude]


def _written_base(df: DataFrame, spent: Iterable[DataFrame]) -> DataFrame:
    """The parsed rows, written; ``spent`` tables that only they read go."""
    base = materialize(df)
    forget(*spent)
    return base


def _parsing(loans: DataFrame, base: DataFrame, *more: dict) -> Parsed:
    """The columns of ``base`` that ``_parsed`` and the steps in ``more`` make of the loans' own ones; dates are small, and dear to parse again."""
    again = [c for c in base.columns if c not in (*loans.columns, "issueDate_dt", "earliest_dt")]

    def anew(rows: DataFrame) -> DataFrame:
        rows = _parsed(rows)
        for cols in more:
            rows = rows.withColumns(cols)
        return rows

    return again, anew


def _high(df: DataFrame, cfg: FeatureConfig, cats: list[str], others: Iterable[str]) -> tuple[list[str], list[str]]:
    """E10 the high-cardinality categories, and those of them whose ``<c>_freq`` is not among the columns yet."""
    high = encode.high_cardinality_columns(df, cats, cfg.high_card_threshold)
    names = {*df.columns, *others}
    return high, [c for c in high if f"{c}_freq" not in names]


def _freq_names(c: str, freq_cols: list[str], need: list[str]) -> list[str]:
    return [c.replace("_cat", "_freq")] * (c in freq_cols) + [f"{c}_freq"] * (c in need)


Lookup = Callable[[DataFrame, str, bool], DataFrame]  # rows, key column, whether it has few values
Parsed = tuple[list[str], Callable[[DataFrame], DataFrame]]  # columns parsed from those of the loans, and the step that does it


def _with_lookups(df: DataFrame, written: DataFrame, keys: Iterable[str], few: set[str], lookup: Lookup, parsed: Parsed) -> tuple[DataFrame, DataFrame]:
    """The rows with the lookups of ``keys``, and the written table they read.

    A column of many values deals out the rows by its key; its result is written, so that
    shuffle and the table before (``written``, which ``df`` is made of) go before the next. Only what
    can't be parsed again is dealt out; the rest is parsed again as the result is written.
    """
    keys, (again, anew) = list(keys), parsed
    for c in keys:
        if c not in few:
            wider = materialize(anew(lookup(df, c, False).drop(*again)))
            forget(written)
            df = written = wider
    for c in keys:
        if c in few:
            df = lookup(df, c, True)
    return df, written


def _with_freq(df: DataFrame, cols: dict, freq_cols: list[str], need: list[str], parsed: Parsed) -> tuple[DataFrame, list[DataFrame]]:
    """The written rows with the derived ``cols`` and the frequencies of ``freq_cols`` and ``need``, and the tables they read."""
    keys = list(dict.fromkeys(freq_cols + need))
    if not keys:
        return df.withColumns(cols), [df]
    order = list(dict.fromkeys([*df.columns, *cols, *[_freq_names(c, freq_cols, [])[0] for c in freq_cols], *[f"{c}_freq" for c in need]]))
    written, df = df, df.withColumns({c: cols[c] for c in keys if c in cols})
    table = encode.fit_freq(df, keys)

    def lookup(rows: DataFrame, c: str, few: bool) -> DataFrame:
        first, *more = _freq_names(c, freq_cols, need)
        return encode.apply_freq(rows, table, c, first, few).withColumns({n: F.col(first) for n in more})

    df, written = _with_lookups(df, written, keys, encode.few_valued(table), lookup, parsed)
    return df.withColumns(cols).select(*order), [written, table]


class _Fits:
    """The fitted encoders of all key columns as one table, looked up once a key column."""

    def __init__(self, base: DataFrame, keys: list[str], freq_cols: list[str], te_cols: list[str], crosses: list[str] = (),
                 past_cols: list[str] = (), te: encode.KFoldTE | encode.BlockTE | None = None, past: encode.PastRate | None = None):
        self.base, self.keys, self.freq_cols, self.te_cols, self.crosses, self.past_cols = base, keys, freq_cols, te_cols, crosses, past_cols
        self.te, self.past, self.need, self.table, self.few, self.null_share = te, past, [], None, set(), {}

    def names(self) -> list[str]:
        """The columns the lookups add, in order, without those that ``high`` asks for."""
        return [n for c in self.keys for n in (
            [c.replace("_cat", "_freq")] * (c in self.freq_cols) + [f"{c}_freq"] * (c in self.crosses)
            + [f"te_{c}"] * (c in self.te_cols) + [f"hist_rate_{c}"] * (c in self.past_cols))]

    def high(self, df: DataFrame, cfg: FeatureConfig, cats: list[str], others: Iterable[str]) -> tuple[list[str], list[str]]:
        high, self.need = _high(df, cfg, cats, [*self.names(), *others])
        self.keys = list(dict.fromkeys(self.keys + self.need))
        return high, self.need

    def fit(self) -> None:
        shared = list(dict.fromkeys(self.freq_cols + self.need))
        freq = encode.fit_freq(self.base, shared) if shared else None
        counts = encode.fit_train_count(self.base, self.crosses) if self.crosses else None
        self.table = encode.combine_fits(freq=freq, counts=counts, te=self.te, past=self.past)
        nulls = freq.filter("key = 'nan'").select("col", "freq").collect() if self.need else []  # a row a key column at most
        self.null_share = {r["col"]: r["freq"] for r in nulls}
        self.few = encode.few_valued(self.table)
        forget(freq, counts, self.te and self.te.table, self.past and self.past.table)

    def _lookup(self, rows: DataFrame, c: str, few: bool) -> DataFrame:
        return encode.apply_fits(
            rows, self.table, c, freq=c.replace("_cat", "_freq") if c in self.freq_cols else None,
            cnt=f"{c}_freq" if c in self.crosses else None, te=self.te if c in self.te_cols else None,
            past=self.past if c in self.past_cols else None, few=few,
            share=(f"{c}_freq", self.null_share.get(c)) if c in self.need else None)

    def joined(self, df: DataFrame, written: DataFrame, parsed: Parsed) -> tuple[DataFrame, DataFrame]:
        """The rows with all lookups, and the written table they read."""
        if self.keys:
            self.fit()
        return _with_lookups(df, written, self.keys, self.few, self._lookup, parsed)


def _finish(df: DataFrame, cfg: FeatureConfig, cat_cols: list[str], high: list[str], spent: Iterable[DataFrame], drop=()) -> FeatureTable:
    """Drop temporaries, inf→null, median-fill, downgrade high-cardinality
    categories (E10) and list the trainable features (P3)."""
    # The lookups run once, into a written table; the fits below read that table instead
    # of re-running them, and so does the caller. What it was made of goes.
    df = materialize(df.drop(*[c for c in drop if c in df.columns]))
    forget(*spent)
    protected = {ID, TARGET, SPLIT}
    kept = protected | set(LOW_CARD_AS_CATEGORY) | set(cat_cols)  # D18: never filled
    df = stats.inf_to_null(df, _floating(df, kept))
    # only columns holding a null need their median (filling the others is a
    # no-op), so the ranking pass covers just those; integers become doubles
    need = stats.columns_with_nulls(df, stats.numeric_columns(df, kept))
    med = stats.fit_median(df, need, cfg.quantile_accuracy)
    df = stats.apply_median(df, med)
    cats = [c for c in cat_cols if c in df.columns and c not in high]
    numeric = [f.name for f in df.schema.fields
               if f.name not in protected and f.name not in cat_cols
               and f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte")]
    features = numeric + cats
    meta = {"id_col": ID, "target": TARGET, "version": cfg.version,
            "high_card_threshold": cfg.high_card_threshold, "high_card": high,
            "medians": med}
    return FeatureTable(df, features, cats, meta)


def _categories(df: DataFrame, extra: list[str]) -> list[str]:
    base = ["term_bin", "employmentLength_cat", "issueDate_cat", "earliesCreditLine_cat",
            "employmentTitle_cat", "title_cat", "postCode_cat"]
    return list(dict.fromkeys(c for c in base + extra + LOW_CARD_AS_CATEGORY if c in df.columns))


def _n_stats(df: DataFrame, nulls: str, extended: bool) -> tuple[dict, list[str]]:
    n_cols = [c for c in N_COLS if c in df.columns]
    if not n_cols:
        return {}, []
    out = derive.column_stats(n_cols, nulls)
    if extended:
        out.update(derive.row_stats_ext(derive.n_array(n_cols, nulls)))
    return out, n_cols


# ------------------------------------------------------------------ version 1


def build_features_v1(loans: DataFrame, cfg: FeatureConfig | None = None, spent: Iterable[DataFrame] = ()) -> FeatureTable:
    """E11: parsers, fico mean, two income ratios, frequencies, row stats
    (zero-filled), median fill, high-cardinality downgrade (threshold 200)."""
    cfg = cfg or FeatureConfig(version="v1", high_card_threshold=200)
    base = _written_base(_base(loans), spent)
    cols = {}
    if "issueDate" in base.columns:
        cols["issueDate_cat"] = parse.category_copy(F.col("issueDate"))
        cols["issue_year"] = F.year("issueDate_dt").cast("double")
        cols["issue_month"] = F.month("issueDate_dt").cast("double")
    if "earliesCreditLine" in base.columns:
        cols["earliesCreditLine_cat"] = parse.category_copy(F.col("earliesCreditLine"))
    if _present(base, "loanAmnt", "annualIncome"):
        cols["loan_income_ratio"] = derive.ratio("loanAmnt", "annualIncome")
        if "installment" in base.columns and cfg.extra.get("install_to_income", True):
            cols["install_to_income"] = derive.ratio("installment", "annualIncome")
    nst, _ = _n_stats(base, cfg.extra.get("row_stats_nulls", "zero"), False)
    cols.update(nst)
    freq_cols = [c for c in FREQ_COLS if c in base.columns]
    whole = base.withColumns(cols)
    cats = _categories(whole, [])
    high, need = _high(whole, cfg, cats, [n for c in freq_cols for n in _freq_names(c, freq_cols, [])])
    df, made_of = _with_freq(base, cols, freq_cols, need, _parsing(loans, base))
    return _finish(df, cfg, cats, high, made_of, drop=("issueDate_dt", "earliest_dt"))


# ------------------------------------------------------------------ version 2

# Fixed settings of the modelled pipeline.
V2_TE = ["employmentTitle_cat", "title_cat", "postCode_cat", "subGrade", "issueDate_cat", "earliesCreditLine_cat"]


def build_features_v2(loans: DataFrame, cfg: FeatureConfig | None = None, spent: Iterable[DataFrame] = ()) -> FeatureTable:
    """E12: version 1 plus fico range, three more ratios, log1p and winsor of
    four money columns, missing indicators, row stats skipping nulls, k-fold
    target encoding of six categories and good/bad WOE of five numerics."""
    cfg = cfg or FeatureConfig(version="v2", high_card_threshold=200)
    texts = {f"{c}_cat": parse.category_copy(F.col(c)) for c in ("issueDate", "earliesCreditLine") if c in loans.columns}
    base = _written_base(_base(loans).withColumns(texts), spent)
    cols = {}
    if "issueDate_dt" in base.columns:
        cols["issue_year"] = F.year("issueDate_dt").cast("double")
        cols["issue_month"] = F.month("issueDate_dt").cast("double")
    if _present(base, "ficoRangeLow", "ficoRangeHigh"):
        cols["fico_range"] = derive.fico_range()
    if _present(base, "loanAmnt", "annualIncome"):
        cols["loan_income_ratio"] = derive.ratio("loanAmnt", "annualIncome")
        if "installment" in base.columns:
            cols["install_to_income"] = derive.ratio("installment", "annualIncome")
    if _present(base, "interestRate", "term_mon"):
        cols["ir_x_term"] = derive.ir_x_term()
    if _present(base, "installment", "loanAmnt"):
        cols["inst_to_loan"] = derive.ratio("installment", "loanAmnt")
    if _present(base, "revolBal", "totalAcc"):
        cols["revol_per_acc"] = derive.ratio("revolBal", "totalAcc")
    money = [c for c in ("annualIncome", "revolBal", "loanAmnt", "installment") if c in base.columns]
    bounds = stats.fit_winsor(base, money, accuracy=cfg.quantile_accuracy) if money else {}
    for c in money:
        cols[f"log1p_{c}"] = derive.log1p_clip(c)
        cols[f"win_{c}"] = derive.clip(c, *bounds[c])
    miss = [c for c in ("revolUtil", "dti", "emp_len_year", "fico_mean", "credit_hist_mon") if c in base.columns]
    for c in stats.columns_with_nulls(base, miss) if miss else []:
        cols[f"{c}_isna"] = F.col(c).isNull().cast("int")
    nst, _ = _n_stats(base, "skip", False)
    cols.update(nst)

    freq_cols = [c for c in FREQ_COLS if c in base.columns]
    te_cols = [c for c in V2_TE if c in base.columns and TARGET in base.columns]
    woe_cols = [c for c in ("fico_mean", "credit_hist_mon", "interestRate", "dti", "revolUtil") if c in base.columns]
    woe = {}
    if woe_cols and TARGET in base.columns:
        woe = encode.fit_woe_multi(base, woe_cols, q=cfg.woe_bins, style="good_bad", accuracy=cfg.quantile_accuracy)
    cats = _categories(base, [])
    te = encode.fit_kfold_te(base, te_cols, k=cfg.te_folds, m=cfg.te_m) if te_cols else None
    found = _Fits(base, list(dict.fromkeys(freq_cols + te_cols)), freq_cols, te_cols, te=te)
    high, need = found.high(base, cfg, cats, [*cols, *[f"woe_{c}" for c in woe]])
    order = [*base.columns, *cols, *found.names(), *[f"woe_{c}" for c in woe], *[f"{c}_freq" for c in need]]
    df, written = found.joined(base, base, _parsing(loans, base, texts))
    df = df.withColumns(cols)
    for c, model in woe.items():
        df = encode.apply_woe(df, model, c)
    return _finish(df.select(*order), cfg, cats, high, [written, found.table], drop=("issueDate_dt", "earliest_dt"))


# ------------------------------------------------------------------ version 3


# Fixed settings of the modelled pipeline.
V3_TE = ["grade_term", "fico_dti", "purpose_home", "iy_region", "subGrade", "employmentLength_cat", "postCode_cat"]
V3_PAST = ["regionCode", "grade", "purpose", "postCode_cat"]
V3_WOE = ["credit_hist_mon", "revolUtil", "dti"]
V3_LOG_WIN = ["loanAmnt", "annualIncome", "revolBal", "revolUtil", "dti"]


def build_features_v3(loans: DataFrame, cfg: FeatureConfig | None = None, spent: Iterable[DataFrame] = ()) -> FeatureTable:
    """E13 (flagship): time keys, vintage rank, cyclic month, ratios, log1p +
    winsor, frequencies, extended row stats with entropy, four crosses with
    train counts, time-aware target means, past default rates, bad/good WOE."""
    cfg = cfg or FeatureConfig(version="v3", high_card_threshold=300)
    # written once; crosses need quantile bins of fico_mean / dti, fitted on the
    # written rows, and stay expressions over them
    b0 = _written_base(_base(loans), spent)
    acc = cfg.quantile_accuracy
    cross_cols = {}
    bins = {}
    if _present(b0, "fico_mean", "dti"):
        e = encode.fit_quantile_edges_multi(b0, ["fico_mean", "dti"], 20, accuracy=acc)
        bins["fico_bin"], bins["dti_bin"] = e["fico_mean"], e["dti"]
        cross_cols["fico_bin"] = encode.bin_index(F.col("fico_mean").cast("double"), bins["fico_bin"])
        cross_cols["dti_bin"] = encode.bin_index(F.col("dti").cast("double"), bins["dti_bin"])
    b1 = b0.withColumns(cross_cols)
    cc = parse.category_copy
    cx = {}
    if _present(b1, "grade", "term_bin"):
        cx["grade_term"] = F.concat_ws("_", cc(F.col("grade")), cc(F.col("term_bin")))
    if _present(b1, "fico_bin", "dti_bin"):
        cx["fico_dti"] = F.concat_ws("_", cc(F.col("fico_bin")), cc(F.col("dti_bin")))
    if _present(b1, "purpose", "homeOwnership"):
        cx["purpose_home"] = F.concat_ws("_", cc(F.col("purpose")), cc(F.col("homeOwnership")))
    if _present(b1, "regionCode", "issueDate_dt"):
        cx["iy_region"] = F.concat_ws(
            "_", F.coalesce(F.year("issueDate_dt"), F.lit(0)).cast("string"), cc(F.col("regionCode")))
    base = b1.withColumns(cx)

    # ---- fits: each one aggregate job over the written base
    cols = {}
    if "issueDate_dt" in base.columns:
        cols["issue_m_sin"] = parse.month_sin(F.col("issueDate_dt"))
        cols["issue_m_cos"] = parse.month_cos(F.col("issueDate_dt"))
    for name, (n, d, add) in (("pay_ratio", ("installment", "loanAmnt", 1.0)),
                              ("revol_income", ("revolBal", "annualIncome", 1.0)),
                              ("open_ratio", ("openAcc", "totalAcc", 1.0))):
        if _present(base, n, d):
            cols[name] = derive.ratio(n, d, add)
    lw = [c for c in V3_LOG_WIN if c in base.columns]
    bounds = stats.fit_winsor(base, lw, accuracy=acc) if lw else {}
    for c in lw:
        cols[f"{c}_log1p"] = derive.log1p_clip(c)
        cols[f"{c}_w"] = derive.clip(c, *bounds[c])
    nst, n_cols = _n_stats(base, "zero", True)
    cols.update(nst)
    if n_cols:
        mins, maxs = stats.fit_minmax(base, n_cols, fill_zero=True)
        cols["n_entropy"] = derive.row_entropy(n_cols, mins, maxs)

    freq_cols = [c for c in FREQ_COLS if c in base.columns]
    crosses = [c for c in ("grade_term", "fico_dti", "purpose_home", "iy_region") if c in base.columns]
    # a few rows for each fit by month or date: written, so that the planner knows their size
    ranks = materialize(stats.fit_vintage_rank(base, "issueDate_dt")) if "issueDate_dt" in base.columns else None
    timed = TARGET in base.columns and "time_key" in base.columns
    te_cols = [c for c in V3_TE if timed and c in base.columns]
    past_cols = [c for c in V3_PAST if timed and c in base.columns]
    blocks = te = pr = None
    df = base
    if timed:
        blocks = materialize(encode.fit_time_blocks(base, n_blocks=cfg.time_folds,
                                                    min_train_gap=cfg.min_train_months))
        te = encode.fit_block_te(base, te_cols, blocks=blocks) if te_cols else None
        pr = encode.fit_past_rate(base, past_cols) if past_cols else None
        df = encode.with_blocks(df, blocks)
    woe_cols = [c for c in V3_WOE if c in base.columns]
    woe = {}
    if woe_cols and TARGET in base.columns:
        woe = encode.fit_woe_multi(base, woe_cols, q=cfg.woe_bins, style="bad_good", accuracy=acc)
    cats = [c for c in ["term_bin", "employmentLength_cat", "employmentTitle_cat", "title_cat",
                        "postCode_cat", "fico_bin", "dti_bin"] + LOW_CARD_AS_CATEGORY if c in base.columns]
    keys = list(dict.fromkeys(freq_cols + crosses + te_cols + past_cols))
    found = _Fits(base, keys, freq_cols, te_cols, crosses, past_cols, te, pr)
    vintage = ["vintage_rank"] * (ranks is not None)
    high, need = found.high(base, cfg, cats, [*cols, *vintage, *[f"woe_{c}" for c in woe]])
    order = [*base.columns, *cols, *vintage, *found.names(), *[f"woe_{c}" for c in woe], *[f"{c}_freq" for c in need]]
    df, written = found.joined(df, b0, _parsing(loans, base, cross_cols, cx))
    df = df.withColumns(cols)
    if ranks is not None:
        df = stats.apply_vintage_rank(df, ranks, "issueDate_dt")
    for c, model in woe.items():
        df = encode.apply_woe(df, model, c)
    ft = _finish(df.select(*order), cfg, cats, high, [written, found.table, blocks, ranks], drop=("issueDate_dt", "earliest_dt"))
    ft.meta.update({"time_col": cfg.time_col, "time_folds": cfg.time_folds, "quantile_edges": bins})
    return ft


# ------------------------------------------------------------------ notebook


def build_features_nb(loans: DataFrame, cfg: FeatureConfig | None = None, spent: Iterable[DataFrame] = ()) -> FeatureTable:
    """E14: the notebook's set — fico mean/diff, four ratios, date parts,
    row stats skipping nulls with row quantiles, frequencies, median fill."""
    cfg = cfg or FeatureConfig(version="nb", high_card_threshold=200)
    base = _written_base(_base(loans), spent)
    cols = {}
    if _present(base, "ficoRangeLow", "ficoRangeHigh"):
        cols["fico_diff"] = derive.fico_range()
    if _present(base, "loanAmnt", "annualIncome"):
        cols["loan_income_ratio"] = derive.ratio("loanAmnt", "annualIncome")
    if _present(base, "installment", "annualIncome"):
        cols["installment_income_ratio"] = derive.installment_income_ratio()
    if _present(base, "revolBal", "openAcc"):
        cols["revol_bal_per_acc"] = derive.ratio("revolBal", "openAcc")
    if _present(base, "openAcc", "totalAcc"):
        cols["open_to_total"] = derive.ratio("openAcc", "totalAcc")
    if "issueDate_dt" in base.columns:
        d = F.col("issueDate_dt")
        cols.update({"issue_year": F.year(d), "issue_month": F.month(d),
                     "issue_quarter": F.quarter(d), "issue_ym": F.year(d) * 100 + F.month(d)})
    nst, n_cols = _n_stats(base, "skip", False)
    cols.update(nst)
    if n_cols:
        a = derive.n_array(n_cols, "skip")
        cols["n_q25"] = derive.row_quantile(a, 0.25)
        cols["n_q75"] = derive.row_quantile(a, 0.75)
    whole = base.withColumns(cols)
    freq_cols = [c for c in FREQ_COLS if c in base.columns]
    # P15 safety net of the notebook: every remaining text column is a category
    strings = [f.name for f in whole.schema.fields if f.dataType.typeName() == "string"]
    cats = _categories(whole, strings)
    high, need = _high(whole, cfg, cats, [n for c in freq_cols for n in _freq_names(c, freq_cols, [])])
    df, made_of = _with_freq(base, cols, freq_cols, need, _parsing(loans, base))
    return _finish(df, cfg, cats, high, made_of, drop=("issueDate_dt", "earliest_dt"))


def build_features_src(loans: DataFrame, cfg: FeatureConfig | None = None, spent: Iterable[DataFrame] = ()) -> FeatureTable:
    """E15 the single-file trainers' set: version 1 without install_to_income,
    row statistics skipping nulls."""
    cfg = cfg or FeatureConfig(version="src", high_card_threshold=200,
                               extra={"row_stats_nulls": "skip", "install_to_income": False})
    return build_features_v1(loans, cfg, spent)


BUILDERS = {"v1": build_features_v1, "v2": build_features_v2, "v3": build_features_v3,
            "nb": build_features_nb, "src": build_features_src}


def build_features(spark: SparkSession, sf_dir: str, version: str = "v3",
                   cfg: FeatureConfig | None = None) -> FeatureTable:
    loans, steps = staged_loans(spark, sf_dir)
    return BUILDERS[version](supervised_view(loans), cfg, steps)
