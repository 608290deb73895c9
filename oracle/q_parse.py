"""Oracle SQL for scans, parsers, derived numerics and table statistics."""

from __future__ import annotations

from oracle import base as b
from oracle.base import r
from oracle.queries import register


def _emp(x: str) -> str:
    return f"lower(trim({x}))"


def _first_int(s: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({s}, '(\\d+)', 1), '') AS DOUBLE)"


EMP_LEN_YEAR = (
    f"CASE WHEN employmentLength IS NULL THEN NULL "
    f"WHEN contains({_emp('employmentLength')}, '10') THEN 10.0::DOUBLE "
    f"WHEN contains({_emp('employmentLength')}, '<') THEN 0.0::DOUBLE "
    f"ELSE {_first_int(_emp('employmentLength'))} END"
)
EMP_TOKEN = (
    f"CASE WHEN employmentLength IS NULL THEN 'na' "
    f"WHEN contains({_emp('employmentLength')}, '10') THEN '10+' "
    f"WHEN contains({_emp('employmentLength')}, '<') THEN '<1' "
    f"WHEN regexp_extract({_emp('employmentLength')}, '(\\d+)', 1) <> '' "
    f"THEN regexp_extract({_emp('employmentLength')}, '(\\d+)', 1) ELSE 'na' END"
)

PARSED = f"""
p0 AS (
  SELECT *,
    CAST(CASE WHEN term <= 10 THEN term * 12 ELSE term END AS DOUBLE) AS term_mon,
    {EMP_LEN_YEAR} AS emp_len_year,
    {EMP_TOKEN} AS employmentLength_cat,
    {b.parse_date('issueDate')} AS issueDate_dt,
    {b.parse_date('earliesCreditLine')} AS earliest_dt,
    {b.postcode3('postCode')} AS postCode_cat
  FROM sup
),
parsed AS (
  SELECT *,
    CASE WHEN term_mon >= -1 AND term_mon <= 36 THEN '<=36'
         WHEN term_mon > 36 AND term_mon <= 60 THEN '37-60'
         WHEN term_mon > 60 THEN '>60' END AS term_bin,
    {b.time_key('issueDate_dt')} AS time_key,
    CAST(year(issueDate_dt) AS INTEGER) AS issue_year,
    CAST(month(issueDate_dt) AS INTEGER) AS issue_month,
    date_diff('day', earliest_dt, issueDate_dt) / 30.0::DOUBLE AS credit_hist_mon,
    (ficoRangeLow + ficoRangeHigh) / 2.0::DOUBLE AS fico_mean
  FROM p0
)"""


def with_parsed(body: str) -> str:
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return "WITH " + PARSED + ",\n" + body[5:]
    return "WITH " + PARSED + "\n" + body


register("scan_loans", "SELECT * FROM loans")
register("scan_pruned", "SELECT id, isDefault FROM loans")
register("split_train_test", "SELECT * EXCLUDE (is_train) FROM loans WHERE is_train = 1")
register(
    "union_train_test",
    "SELECT * EXCLUDE (is_train), 1 AS is_train FROM loans WHERE is_train = 1 "
    "UNION ALL SELECT * EXCLUDE (is_train) REPLACE (CAST(NULL AS INTEGER) AS isDefault), 0 AS is_train "
    "FROM loans WHERE is_train = 0",
)
register("parse_term", with_parsed("SELECT id, term, term_mon, term_bin FROM parsed"))
register("term_bin", with_parsed("SELECT id, term_bin FROM parsed"))
register("parse_emp_length", with_parsed("SELECT id, employmentLength, emp_len_year FROM parsed"))
register("emp_length_token", with_parsed("SELECT id, employmentLength_cat FROM parsed"))
register("parse_dates", with_parsed("SELECT id, issueDate_dt, earliest_dt FROM parsed"))
register(
    "date_parts",
    with_parsed(
        "SELECT id, CAST(year(issueDate_dt) AS INTEGER) AS issue_year, "
        "CAST(month(issueDate_dt) AS INTEGER) AS issue_month, "
        "CAST(quarter(issueDate_dt) AS INTEGER) AS issue_quarter, "
        "CAST(year(issueDate_dt) * 100 + month(issueDate_dt) AS INTEGER) AS issue_ym FROM parsed"
    ),
)
register("credit_history", with_parsed(f"SELECT id, {r('credit_hist_mon')} AS credit_hist_mon FROM parsed"))
register("time_key", with_parsed("SELECT id, time_key FROM parsed"))
_M = "coalesce(month(issueDate_dt), 1)"
register(
    "month_cyclic",
    with_parsed(
        f"SELECT id, {r(f'sin(6.283185307179586 * {_M} / 12)')} AS issue_m_sin, "
        f"{r(f'cos(6.283185307179586 * {_M} / 12)')} AS issue_m_cos FROM parsed"
    ),
)
register("postcode3", with_parsed("SELECT id, postCode, postCode_cat FROM parsed"))
register(
    "category_copy",
    "SELECT id, "
    + ", ".join(
        f"{b.category_copy(c)} AS {c}_cat"
        for c in ("employmentTitle", "title", "issueDate", "earliesCreditLine")
    )
    + " FROM sup",
)
register(
    "coerce_numeric",
    "SELECT id, TRY_CAST(trim(employmentLength) AS DOUBLE) AS emp_num, "
    "TRY_CAST(trim(CAST(term AS VARCHAR)) AS DOUBLE) AS term_num FROM sup",
)

# ---------------------------------------------------------------- ratios etc.

RATIOS = {
    "loan_income_ratio": ("loanAmnt", "annualIncome"),
    "install_to_income": ("installment", "annualIncome"),
    "inst_to_loan": ("installment", "loanAmnt"),
    "pay_ratio": ("installment", "loanAmnt"),
    "revol_per_acc": ("revolBal", "totalAcc"),
    "revol_bal_per_acc": ("revolBal", "openAcc"),
    "revol_income": ("revolBal", "annualIncome"),
    "open_ratio": ("openAcc", "totalAcc"),
    "open_to_total": ("openAcc", "totalAcc"),
}
_ratio_cols = [
    f"{r('fico_mean')} AS fico_mean",
    f"{r('ficoRangeHigh - ficoRangeLow')} AS fico_range",
    *[f"{r(f'CAST({n} AS DOUBLE) / (CAST({d} AS DOUBLE) + 1.0::DOUBLE)')} AS {k}" for k, (n, d) in RATIOS.items()],
    f"{r('installment / (annualIncome / 12.0::DOUBLE + 1e-6::DOUBLE)')} AS installment_income_ratio",
    f"{r('interestRate * term_mon')} AS ir_x_term",
]
register("ratios", with_parsed("SELECT id, " + ", ".join(_ratio_cols) + " FROM parsed"))

LOG1P_COLS = ["loanAmnt", "annualIncome", "revolBal", "revolUtil", "dti", "installment"]
register(
    "log1p_clip",
    "SELECT id, "
    + ", ".join(
        f"{r(f'CASE WHEN {c} IS NOT NULL THEN ln(1 + greatest(CAST({c} AS DOUBLE), 0.0::DOUBLE)) END')} AS log1p_{c}"
        for c in LOG1P_COLS
    )
    + " FROM sup",
)

WINSOR_COLS = ["loanAmnt", "annualIncome", "revolBal", "revolUtil", "dti", "installment"]
register(
    "winsorize",
    "WITH q AS (SELECT "
    + ", ".join(
        f"quantile_cont({c}, 0.005::DOUBLE) AS lo_{c}, quantile_cont({c}, 0.995::DOUBLE) AS hi_{c}"
        for c in WINSOR_COLS
    )
    + " FROM sup)\nSELECT id, "
    + ", ".join(
        f"{r(f'CASE WHEN {c} < lo_{c} THEN lo_{c} WHEN {c} > hi_{c} THEN hi_{c} ELSE {c} END')} AS win_{c}"
        for c in WINSOR_COLS
    )
    + " FROM sup, q",
)

register(
    "missing_indicator",
    with_parsed(
        "SELECT id, CAST(revolUtil IS NULL AS INTEGER) AS revolUtil_isna, "
        "CAST(dti IS NULL AS INTEGER) AS dti_isna, "
        "CAST(emp_len_year IS NULL AS INTEGER) AS emp_len_year_isna FROM parsed"
    ),
)

N_PRESENT = ["n0", "n1", "n2", "n3", "n4", "n5"]
ZERO_ARR = "[" + ", ".join(f"coalesce({c}, 0.0::DOUBLE)" for c in N_PRESENT) + "]"
SKIP_ARR = "list_filter([" + ", ".join(N_PRESENT) + "], lambda x: x IS NOT NULL)"


def _row_stats(arr: str) -> str:
    return f"""
WITH a AS (SELECT id, {arr} AS a FROM sup)
SELECT id,
  {r('coalesce(list_sum(a), 0.0)')} AS n_sum,
  {r('CASE WHEN len(a) > 0 THEN coalesce(list_sum(a), 0.0) / len(a) END')} AS n_mean,
  {r('list_max(a)')} AS n_max,
  {r('CASE WHEN len(a) > 1 THEN list_stddev_samp(a) END')} AS n_std,
  {r('len(list_filter(a, lambda x: x > 0))')} AS n_nonzero
FROM a"""


register("row_stats", _row_stats(ZERO_ARR))
register("row_stats_skip", _row_stats(SKIP_ARR))
register(
    "row_stats_ext",
    f"""
WITH a AS (SELECT id, {ZERO_ARR} AS a FROM sup)
SELECT id,
  {r('CASE WHEN len(a) > 0 THEN len(list_filter(a, lambda x: x > 0)) / len(a) END')} AS n_pos_rate,
  {r('coalesce(list_sum(list_slice(list_reverse_sort(a), 1, 3)), 0.0)')} AS n_top3
FROM a""",
)


def _row_q(p: float) -> str:
    pos = f"((len(s) - 1) * {p!r}::DOUBLE)"
    lo = f"CAST(floor({pos}) AS INTEGER)"
    a_lo = f"s[{lo} + 1]"
    a_hi = f"s[least({lo} + 2, len(s))]"
    return f"CASE WHEN len(s) > 0 THEN {a_lo} + ({a_hi} - {a_lo}) * ({pos} - {lo}) END"


register(
    "row_quantiles",
    f"WITH a AS (SELECT id, list_sort({SKIP_ARR}) AS s FROM sup)\n"
    f"SELECT id, {r(_row_q(0.25))} AS n_q25, {r(_row_q(0.75))} AS n_q75 FROM a",
)

_ent_terms = []
for c in N_PRESENT:
    z = (
        f"least(greatest((coalesce({c}, 0.0) - mn_{c}) / (mx_{c} - mn_{c} + 1e-6::DOUBLE), 1e-6::DOUBLE), "
        f"1 - 1e-6::DOUBLE)"
    )
    _ent_terms.append(f"(-({z} * ln({z}) + (1 - {z}) * ln(1 - {z})))")
register(
    "row_entropy",
    "WITH mm AS (SELECT "
    + ", ".join(f"min(coalesce({c}, 0.0)) AS mn_{c}, max(coalesce({c}, 0.0)) AS mx_{c}" for c in N_PRESENT)
    + " FROM sup)\nSELECT id, "
    + r("(" + " + ".join(_ent_terms) + f") / {float(len(N_PRESENT))!r}")
    + " AS n_entropy FROM sup, mm",
)

register(
    "vintage_rank",
    with_parsed(
        """
WITH v AS (SELECT issueDate_dt AS d, count(*) AS c FROM parsed WHERE issueDate_dt IS NOT NULL GROUP BY 1),
vr AS (
  SELECT d, (coalesce(sum(c) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            + (c + 1) / 2.0::DOUBLE) / sum(c) OVER () AS vr
  FROM v
)
SELECT id, """
        + r("coalesce(vr.vr, 0.0)")
        + """ AS vintage_rank FROM parsed LEFT JOIN vr ON parsed.issueDate_dt = vr.d"""
    ),
)

IMPUTE_COLS = ["loanAmnt", "interestRate", "installment", "annualIncome", "dti", "ficoRangeLow",
               "ficoRangeHigh", "openAcc", "revolBal", "revolUtil", "totalAcc", "n2", "n5"]


def _finite(c: str) -> str:
    return f"(CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END)"


register(
    "impute_median",
    "WITH m AS (SELECT "
    + ", ".join(f"median({_finite(c)}) AS m_{c}" for c in IMPUTE_COLS)
    + " FROM sup)\nSELECT id, "
    + ", ".join(f"{r(f'coalesce({_finite(c)}, m_{c})')} AS {c}" for c in IMPUTE_COLS)
    + " FROM sup, m",
)

# Numeric columns of the raw loan view and whether they are integers.
LOAN_NUMERIC = [
    ("id", "int"), ("is_train", "int"), ("isDefault", "int"), ("loanAmnt", "float"),
    ("term", "int"), ("interestRate", "float"), ("installment", "float"),
    ("employmentTitle", "float"), ("annualIncome", "float"), ("postCode", "float"),
    ("regionCode", "int"), ("dti", "float"), ("ficoRangeLow", "float"), ("ficoRangeHigh", "float"),
    ("openAcc", "float"), ("revolBal", "float"), ("revolUtil", "float"), ("totalAcc", "float"),
    ("title", "float"), ("policyCode", "float"),
    ("n0", "float"), ("n1", "float"), ("n2", "float"), ("n3", "float"), ("n4", "float"), ("n5", "float"),
]


def _np_type_sql(kind: str) -> str:
    if kind == "float":
        return "'float32'"
    return (
        "CASE WHEN mn IS NULL THEN 'int64' WHEN mn >= 0 THEN "
        "(CASE WHEN mx < 255 THEN 'uint8' WHEN mx < 65535 THEN 'uint16' "
        "WHEN mx < 4294967295 THEN 'uint32' ELSE 'uint64' END) "
        "ELSE (CASE WHEN mn >= -128 AND mx <= 127 THEN 'int8' "
        "WHEN mn >= -32768 AND mx <= 32767 THEN 'int16' "
        "WHEN mn >= -2147483648 AND mx <= 2147483647 THEN 'int32' ELSE 'int64' END) END"
    )


def _spark_type_sql(kind: str) -> str:
    if kind == "float":
        return "'float'"
    return (
        "CASE WHEN mn IS NULL THEN 'bigint' WHEN mn >= -128 AND mx <= 127 THEN 'tinyint' "
        "WHEN mn >= -32768 AND mx <= 32767 THEN 'smallint' "
        "WHEN mn >= -2147483648 AND mx <= 2147483647 THEN 'int' ELSE 'bigint' END"
    )


register(
    "type_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS col, '{k}' AS kind, mn AS min_value, mx AS max_value, "
        f"{_np_type_sql(k)} AS np_type, {_spark_type_sql(k)} AS spark_type "
        f"FROM (SELECT min(CAST({c} AS DOUBLE)) AS mn, max(CAST({c} AS DOUBLE)) AS mx FROM loans)"
        for c, k in LOAN_NUMERIC
    ),
)


def qbin_edges(col: str, q: int, src: str, where: str = "TRUE") -> str:
    """Sorted distinct exact quantile edges as a list expression subquery."""
    probs = ", ".join(f"{i / q!r}::DOUBLE" for i in range(q + 1))
    return (
        f"(SELECT list_sort(list_distinct(quantile_cont(CAST({col} AS DOUBLE), [{probs}]))) "
        f"FROM {src} WHERE {col} IS NOT NULL AND isfinite(CAST({col} AS DOUBLE)) AND {where})"
    )


def bin_index(x: str, e: str) -> str:
    """Right-closed bin id with the lowest edge included; outside/null → NULL."""
    return (
        f"CASE WHEN len({e}) >= 2 AND {x} >= {e}[1] AND {x} <= {e}[len({e})] "
        f"THEN CAST(len(list_filter({e}[2:], lambda t: t < {x})) AS INTEGER) END"
    )


QBINS = f"""
qe AS (SELECT {qbin_edges('fico_mean', 20, 'parsed')} AS fe, {qbin_edges('dti', 20, 'parsed')} AS de),
binned AS (
  SELECT parsed.*, {bin_index('fico_mean', 'fe')} AS fico_bin, {bin_index('dti', 'de')} AS dti_bin
  FROM parsed, qe
)"""

register("quantile_bins", with_parsed("WITH " + QBINS + "\nSELECT id, fico_bin, dti_bin FROM binned"))

CROSSES = f"""
crossed AS (
  SELECT binned.*,
    coalesce(grade, 'nan') || '_' || coalesce(term_bin, 'nan') AS grade_term,
    coalesce(CAST(fico_bin AS VARCHAR), 'nan') || '_' || coalesce(CAST(dti_bin AS VARCHAR), 'nan') AS fico_dti,
    coalesce(purpose, 'nan') || '_' || coalesce(homeOwnership, 'nan') AS purpose_home,
    CAST(coalesce(year(issueDate_dt), 0) AS VARCHAR) || '_' || coalesce(CAST(regionCode AS VARCHAR), 'nan') AS iy_region
  FROM binned
)"""

register(
    "cross_features",
    with_parsed("WITH " + QBINS + "," + CROSSES + "\nSELECT id, grade_term, fico_dti, purpose_home, iy_region FROM crossed"),
)

register(
    "inf_to_null",
    with_parsed(
        "WITH rr AS (SELECT id, "
        "CAST(loanAmnt AS DOUBLE) / (CAST(annualIncome AS DOUBLE) + 1.0::DOUBLE) AS loan_income_ratio, "
        "CAST(revolBal AS DOUBLE) / (CAST(annualIncome AS DOUBLE) + 1.0::DOUBLE) AS revol_income, "
        "CAST(openAcc AS DOUBLE) / (CAST(totalAcc AS DOUBLE) + 1.0::DOUBLE) AS open_ratio, "
        "interestRate * term_mon AS ir_x_term FROM parsed)\nSELECT id, "
        + ", ".join(f"{r(f'CASE WHEN isfinite({c}) THEN {c} END')} AS {c}"
                    for c in ("loan_income_ratio", "revol_income", "open_ratio", "ir_x_term"))
        + " FROM rr"
    ),
)

register(
    "parse_dates_any",
    "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS compact, CAST(o_orderdate AS DATE) AS timed, "
    "CAST(o_orderdate AS DATE) AS american, CAST(date_trunc('month', o_orderdate) AS DATE) AS long_month, "
    "CAST(o_orderdate AS DATE) AS named FROM orders",
)
