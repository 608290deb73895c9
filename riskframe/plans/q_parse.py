"""Queries for scans, parsers, derived numerics and table statistics
(SURVEY §2.1-2.4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from riskframe.functions import derive, parse
from riskframe.operators import encode, stats
from riskframe.plans.catalog import query
from riskframe.plans.common import rnd
from riskframe.sources.tables import read_table
from riskframe.sources.loans import load_loans, split_train_test, supervised_view
from riskframe.sources.loans import union_train_test as _union

N_PRESENT = ["n0", "n1", "n2", "n3", "n4", "n5"]
LOG1P_COLS = ["loanAmnt", "annualIncome", "revolBal", "revolUtil", "dti", "installment"]
WINSOR_COLS = ["loanAmnt", "annualIncome", "revolBal", "revolUtil", "dti", "installment"]
MISSING_CANDIDATES = ["revolUtil", "dti", "emp_len_year", "fico_mean", "credit_hist_mon"]


def parsed(df: DataFrame) -> DataFrame:
    """All row-level parsers of the feature builders in one projection."""
    t = df.schema
    issue = parse.parse_date(F.col("issueDate"))
    earliest = parse.parse_date(F.col("earliesCreditLine"))
    term_mon = parse.parse_term(F.col("term"), t["term"].dataType)
    out = df.select(
        "*",
        term_mon.alias("term_mon"),
        parse.parse_emp_length(F.col("employmentLength")).alias("emp_len_year"),
        parse.emp_length_token(F.col("employmentLength")).alias("employmentLength_cat"),
        issue.alias("issueDate_dt"),
        earliest.alias("earliest_dt"),
        parse.postcode3(F.col("postCode"), t["postCode"].dataType).alias("postCode_cat"),
    )
    return out.select(
        "*",
        parse.term_bin(F.col("term_mon")).alias("term_bin"),
        parse.time_key(F.col("issueDate_dt")).alias("time_key"),
        F.year("issueDate_dt").alias("issue_year"),
        F.month("issueDate_dt").alias("issue_month"),
        parse.credit_history_months(F.col("issueDate_dt"), F.col("earliest_dt")).alias("credit_hist_mon"),
        derive.fico_mean().alias("fico_mean"),
    )


def _loans(spark, sf_dir, supervised=True):
    loans = load_loans(spark, sf_dir)
    return supervised_view(loans) if supervised else loans


# ---------------------------------------------------------------- S1, S2, P1, U1


@query("scan_loans")
def q_scan_loans(spark, sf_dir):
    """S1 the raw loan table."""
    return _loans(spark, sf_dir, supervised=False)


@query("scan_pruned")
def q_scan_pruned(spark, sf_dir):
    """S2 only id + target (column pruning reaches the Parquet scans)."""
    return _loans(spark, sf_dir, supervised=False).select("id", "isDefault")


@query("split_train_test")
def q_split(spark, sf_dir):
    """P1 train part: flag dropped."""
    train, _ = split_train_test(_loans(spark, sf_dir, supervised=False))
    return train


@query("union_train_test")
def q_union(spark, sf_dir):
    """U1 union by name of the two parts; the test side has no target."""
    train, test = split_train_test(_loans(spark, sf_dir, supervised=False))
    return _union(train, test)


# ---------------------------------------------------------------- R1-R11


@query("parse_term")
def q_parse_term(spark, sf_dir):
    df = parsed(_loans(spark, sf_dir))
    return df.select("id", "term", "term_mon", "term_bin")


@query("term_bin")
def q_term_bin(spark, sf_dir):
    return parsed(_loans(spark, sf_dir)).select("id", "term_bin")


@query("parse_emp_length")
def q_parse_emp_length(spark, sf_dir):
    return parsed(_loans(spark, sf_dir)).select("id", "employmentLength", "emp_len_year")


@query("emp_length_token")
def q_emp_length_token(spark, sf_dir):
    return parsed(_loans(spark, sf_dir)).select("id", "employmentLength_cat")


@query("parse_dates")
def q_parse_dates(spark, sf_dir):
    return parsed(_loans(spark, sf_dir)).select("id", "issueDate_dt", "earliest_dt")


@query("parse_dates_any")
def q_parse_dates_any(spark, sf_dir):
    """R4 the general fallback: order dates in spellings that no listed format fits."""
    orders = read_table(spark, sf_dir, "orders")
    d = F.col("o_orderdate").cast("date")
    spelled = {"compact": "yyyyMMdd", "timed": "yyyy-MM-dd 00:00:00", "american": "M/d/yyyy", "long_month": "MMMM yyyy", "named": "d MMM yyyy"}
    return orders.select(F.col("o_orderkey").alias("id"), *[parse.parse_date(F.date_format(d, f)).alias(n) for n, f in spelled.items()])


@query("date_parts")
def q_date_parts(spark, sf_dir):
    """R6 year, month, quarter, year*100+month of the issue date."""
    d = F.col("issueDate_dt")
    return parsed(_loans(spark, sf_dir)).select(
        "id", F.year(d).alias("issue_year"), F.month(d).alias("issue_month"),
        F.quarter(d).alias("issue_quarter"), (F.year(d) * 100 + F.month(d)).alias("issue_ym"),
    )


@query("credit_history")
def q_credit_history(spark, sf_dir):
    return parsed(_loans(spark, sf_dir)).select("id", rnd("credit_hist_mon").alias("credit_hist_mon"))


@query("time_key")
def q_time_key(spark, sf_dir):
    return parsed(_loans(spark, sf_dir)).select("id", "time_key")


@query("month_cyclic")
def q_month_cyclic(spark, sf_dir):
    d = F.col("issueDate_dt")
    return parsed(_loans(spark, sf_dir)).select(
        "id", rnd(parse.month_sin(d)).alias("issue_m_sin"), rnd(parse.month_cos(d)).alias("issue_m_cos")
    )


@query("postcode3")
def q_postcode3(spark, sf_dir):
    return parsed(_loans(spark, sf_dir)).select("id", "postCode", "postCode_cat")


@query("category_copy")
def q_category_copy(spark, sf_dir):
    df = _loans(spark, sf_dir)
    return df.select(
        "id", *[parse.category_copy(F.col(c)).alias(f"{c}_cat")
                for c in ("employmentTitle", "title", "issueDate", "earliesCreditLine")]
    )


@query("coerce_numeric")
def q_coerce_numeric(spark, sf_dir):
    """P8 text → number, anything unparsable → null."""
    df = _loans(spark, sf_dir)
    return df.select(
        "id",
        parse.coerce_numeric(F.col("employmentLength"), df.schema["employmentLength"].dataType).alias("emp_num"),
        parse.coerce_numeric(F.col("term").cast("string"), StringType()).alias("term_num"),
    )


# ---------------------------------------------------------------- N1-N22


@query("ratios")
def q_ratios(spark, sf_dir):
    df = parsed(_loans(spark, sf_dir))
    cols = {
        "fico_mean": derive.fico_mean(),
        "fico_range": derive.fico_range(),
        **{k: derive.ratio(*v) for k, v in derive.RATIOS.items()},
        "installment_income_ratio": derive.installment_income_ratio(),
        "ir_x_term": derive.ir_x_term(),
    }
    return df.select("id", *[rnd(v).alias(k) for k, v in cols.items()])


@query("log1p_clip")
def q_log1p(spark, sf_dir):
    df = _loans(spark, sf_dir)
    return df.select("id", *[rnd(derive.log1p_clip(c)).alias(f"log1p_{c}") for c in LOG1P_COLS])


@query("winsorize")
def q_winsorize(spark, sf_dir):
    """N13 clip to the 0.5 % / 99.5 % quantiles over train + test."""
    df = _loans(spark, sf_dir).select("id", *WINSOR_COLS)
    bounds = stats.fit_winsor(df, WINSOR_COLS)
    out = stats.apply_winsor(df, bounds, {c: f"win_{c}" for c in WINSOR_COLS})
    return out.select("id", *[rnd(f"win_{c}").alias(f"win_{c}") for c in WINSOR_COLS])


@query("missing_indicator")
def q_missing_indicator(spark, sf_dir):
    df = parsed(_loans(spark, sf_dir)).select("id", *MISSING_CANDIDATES)
    out = stats.add_missing_indicator(df, MISSING_CANDIDATES)
    return out.select("id", *[c for c in out.columns if c.endswith("_isna")])


def _n_stats(df, nulls):
    a = derive.n_array(N_PRESENT, nulls)
    st = derive.row_stats(a)
    return df.select("id", *[rnd(v).alias(k) for k, v in st.items()])


@query("row_stats")
def q_row_stats(spark, sf_dir):
    """N15 with nulls zero-filled (feature versions 1 and 3)."""
    return _n_stats(_loans(spark, sf_dir), "zero")


@query("row_stats_skip")
def q_row_stats_skip(spark, sf_dir):
    """N15 with nulls skipped (version 2, notebook, single-file trainers)."""
    return _n_stats(_loans(spark, sf_dir), "skip")


@query("row_stats_ext")
def q_row_stats_ext(spark, sf_dir):
    a = derive.n_array(N_PRESENT, "zero")
    st = derive.row_stats_ext(a)
    return _loans(spark, sf_dir).select("id", *[rnd(v).alias(k) for k, v in st.items()])


@query("row_quantiles")
def q_row_quantiles(spark, sf_dir):
    a = derive.n_array(N_PRESENT, "skip")
    return _loans(spark, sf_dir).select(
        "id", rnd(derive.row_quantile(a, 0.25)).alias("n_q25"), rnd(derive.row_quantile(a, 0.75)).alias("n_q75")
    )


@query("row_entropy")
def q_row_entropy(spark, sf_dir):
    df = _loans(spark, sf_dir).select("id", *N_PRESENT)
    mins, maxs = stats.fit_minmax(df, N_PRESENT, fill_zero=True)
    return df.select("id", rnd(derive.row_entropy(N_PRESENT, mins, maxs)).alias("n_entropy"))


@query("vintage_rank")
def q_vintage_rank(spark, sf_dir):
    df = parsed(_loans(spark, sf_dir)).select("id", "issueDate_dt")
    out = stats.vintage_rank(df, "issueDate_dt")
    return out.select("id", rnd("vintage_rank").alias("vintage_rank"))


IMPUTE_COLS = ["loanAmnt", "interestRate", "installment", "annualIncome", "dti", "ficoRangeLow",
               "ficoRangeHigh", "openAcc", "revolBal", "revolUtil", "totalAcc", "n2", "n5"]


@query("impute_median")
def q_impute_median(spark, sf_dir):
    """N21 (after P10): nulls/NaN/inf → the column median over train + test."""
    df = _loans(spark, sf_dir).select("id", *IMPUTE_COLS)
    med = stats.fit_median(df, IMPUTE_COLS)
    out = stats.apply_median(df, med)
    return out.select("id", *[rnd(c).alias(c) for c in IMPUTE_COLS])


@query("type_profile")
def q_type_profile(spark, sf_dir):
    """P13 re-aimed: smallest type per numeric column (v1/v3 strict rule)."""
    df = _loans(spark, sf_dir, supervised=False)
    cols = stats.numeric_columns(df)
    return stats.type_profile(df, cols)


@query("quantile_bins")
def q_quantile_bins(spark, sf_dir):
    """E7 20 equal-frequency bins of fico_mean and dti over train + test."""
    df = parsed(_loans(spark, sf_dir)).select("id", "fico_mean", "dti")
    df = encode.quantile_bin(df, "fico_mean", 20, "fico_bin")
    df = encode.quantile_bin(df, "dti", 20, "dti_bin")
    return df.select("id", "fico_bin", "dti_bin")


def cross_columns(df: DataFrame) -> DataFrame:
    """N22 crosses of two stringified categories joined by '_' (null → 'nan')."""
    def s(c):
        return parse.category_copy(c if not isinstance(c, str) else F.col(c))

    e = encode.fit_quantile_edges_multi(df, ["fico_mean", "dti"], 20)
    df = df.withColumns({"fico_bin": encode.bin_index(F.col("fico_mean").cast("double"), e["fico_mean"]),
                         "dti_bin": encode.bin_index(F.col("dti").cast("double"), e["dti"])})
    return df.withColumns({
        "grade_term": F.concat_ws("_", s("grade"), s("term_bin")),
        "fico_dti": F.concat_ws("_", s("fico_bin"), s("dti_bin")),
        "purpose_home": F.concat_ws("_", s("purpose"), s("homeOwnership")),
        "iy_region": F.concat_ws(
            "_", F.coalesce(F.year("issueDate_dt"), F.lit(0)).cast("string"), s("regionCode")
        ),
    })


CROSSES = ["grade_term", "fico_dti", "purpose_home", "iy_region"]


@query("cross_features")
def q_cross_features(spark, sf_dir):
    df = cross_columns(parsed(_loans(spark, sf_dir)))
    return df.select("id", *CROSSES)



INF_COLS = ["loan_income_ratio", "revol_income", "open_ratio", "ir_x_term"]


@query("inf_to_null")
def q_inf_to_null(spark, sf_dir):
    """P10 NaN/±inf → null on the ratio columns (where a zero divisor would
    leave an infinity in IEEE arithmetic)."""
    df = parsed(_loans(spark, sf_dir))
    ratios = df.select(
        "id",
        derive.ratio("loanAmnt", "annualIncome").alias("loan_income_ratio"),
        derive.ratio("revolBal", "annualIncome").alias("revol_income"),
        derive.ratio("openAcc", "totalAcc").alias("open_ratio"),
        derive.ir_x_term().alias("ir_x_term"),
    )
    out = stats.inf_to_null(ratios, INF_COLS)
    return out.select("id", *[rnd(c).alias(c) for c in INF_COLS])
