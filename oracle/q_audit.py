"""Oracle SQL for the audits."""

from __future__ import annotations

from oracle.base import r
from oracle.q_encode import (
    BLOCK_TE_COLS, ENC_BASE, PAST_RATE_KEYS, WOE_V3_COLS, block_ctes, block_te_ctes, block_te_join,
    block_te_value, past_rate_ctes, past_rate_join, past_rate_value, with_fb, woe_ctes, woe_value,
)
from oracle.q_metrics import PREDS, RUNS, auc_select, score_ctes
from oracle.queries import register

# Columns of the train table (loan view without the split flag), with kinds.
TRAIN_COLUMNS = [
    ("id", "num"), ("isDefault", "num"), ("loanAmnt", "num"), ("term", "num"), ("interestRate", "num"),
    ("installment", "num"), ("grade", "str"), ("subGrade", "str"), ("employmentTitle", "num"),
    ("employmentLength", "str"), ("homeOwnership", "str"), ("annualIncome", "num"), ("issueDate", "str"),
    ("purpose", "str"), ("postCode", "num"), ("regionCode", "num"), ("dti", "num"), ("ficoRangeLow", "num"),
    ("ficoRangeHigh", "num"), ("openAcc", "num"), ("revolBal", "num"), ("revolUtil", "num"), ("totalAcc", "num"),
    ("earliesCreditLine", "str"), ("title", "num"), ("policyCode", "num"),
    ("n0", "num"), ("n1", "num"), ("n2", "num"), ("n3", "num"), ("n4", "num"), ("n5", "num"),
]
NUMERIC = [c for c, k in TRAIN_COLUMNS if k == "num"]

register(
    "basic_profile",
    f"SELECT count(*) AS n_rows, {len(TRAIN_COLUMNS)} AS n_cols, {len(NUMERIC)} AS n_num, "
    f"{len(TRAIN_COLUMNS) - len(NUMERIC)} AS n_str, {r('avg(isDefault)')} AS target_pos_rate "
    "FROM loans WHERE is_train = 1",
)


def _x(c):
    return f"CAST({c} AS DOUBLE)"


MISSING = "miss AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS col, avg(CASE WHEN {_x(c)} IS NULL OR isnan({_x(c)}) THEN 1.0 ELSE 0.0 END) AS nan_ratio, "
    f"CAST(coalesce(sum(CASE WHEN abs({_x(c)}) = 'inf'::DOUBLE THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_inf "
    f"FROM loans WHERE is_train = 1"
    for c in NUMERIC
) + ")"

register("missing_ratio", "WITH " + MISSING + f"\nSELECT col, {r('nan_ratio')} AS nan_ratio FROM miss")
register("inf_counts", "WITH " + MISSING + "\nSELECT col, n_inf FROM miss")
register(
    "top_missing",
    "WITH " + MISSING + f"\nSELECT col, {r('nan_ratio')} AS nan_ratio FROM miss ORDER BY miss.nan_ratio DESC, col LIMIT 5",
)

_woe_long = " UNION ALL ".join(
    f"SELECT 'woe_{c}' AS col, isDefault AS y, woe_{c} AS pred FROM w WHERE is_train = 1" for c in WOE_V3_COLS
)
register(
    "woe_summary",
    with_fb(
        woe_ctes(WOE_V3_COLS, "bad_good")
        + ",\nw AS (SELECT x.id, x.is_train, x.isDefault, "
        + ", ".join(f"{woe_value(c, 'bad_good')} AS woe_{c}" for c in WOE_V3_COLS)
        + " FROM fb x),\nlong AS (" + _woe_long + "),\n"
        "health AS (SELECT col, avg(CASE WHEN pred IS NULL OR isnan(pred) THEN 1.0 ELSE 0.0 END) AS nan_ratio, "
        "CAST(coalesce(sum(CASE WHEN abs(pred) = 'inf'::DOUBLE THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_inf FROM long GROUP BY col),\n"
        "mom AS (SELECT col, avg(pred) AS mean, stddev_pop(pred) AS std FROM long WHERE isfinite(pred) GROUP BY col),"
        + score_ctes("long", ["col"]) + ",\na AS (" + auc_select(["col"]) + ")",
        f"SELECT h.col, {r('h.nan_ratio')} AS nan_ratio, h.n_inf, {r('m.mean')} AS mean, {r('m.std')} AS std, "
        f"{r('a.auc')} AS auc_vs_target FROM health h LEFT JOIN mom m USING (col) LEFT JOIN a USING (col)",
    ),
)

TE_TRAIN = (
    block_ctes("fb") + "," + block_te_ctes(BLOCK_TE_COLS)
    + ",\nte_all AS (SELECT x.id, x.is_train, x.isDefault, x.time_key, "
    + ", ".join(f"x.{c}" for c in BLOCK_TE_COLS) + ", "
    + ", ".join(f"{block_te_value(f't{i}')} AS te_{c}" for i, c in enumerate(BLOCK_TE_COLS))
    + " FROM fb x LEFT JOIN tb xb ON x.time_key = xb.month "
    + " ".join(block_te_join(c, f"t{i}") for i, c in enumerate(BLOCK_TE_COLS))
    + "),\nte AS (SELECT * FROM te_all WHERE is_train = 1)"
)
AUDIT_TE = TE_TRAIN + ",\nlong AS (" + " UNION ALL ".join(
    f"SELECT 'te_{c}' AS te_col, CAST({c} AS VARCHAR) AS key, time_key AS m, CAST(isDefault AS DOUBLE) AS y, "
    f"CAST(te_{c} AS DOUBLE) AS real FROM te" for c in BLOCK_TE_COLS
) + """),
by_key AS (SELECT te_col, key, m, sum(y) AS s, count(*) AS n FROM long WHERE key IS NOT NULL GROUP BY ALL),
past_key AS (SELECT te_col, key, m, sum(s) OVER w AS ks, sum(n) OVER w AS kn FROM by_key
             WINDOW w AS (PARTITION BY te_col, key ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
by_month AS (SELECT time_key AS m, CAST(sum(isDefault) AS DOUBLE) AS s, count(*) AS n FROM te GROUP BY 1),
past_month AS (SELECT m, sum(s) OVER w AS ps, sum(n) OVER w AS pn FROM by_month
               WINDOW w AS (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
j AS (SELECT long.*, ps, pn, ks, kn FROM long JOIN past_month USING (m)
      LEFT JOIN past_key USING (te_col, key, m) WHERE pn > 0),
pm AS (SELECT te_col, m, avg(abs(coalesce(ks / kn, ps / pn) - real)) AS mae_m,
              sqrt(avg((coalesce(ks / kn, ps / pn) - real) * (coalesce(ks / kn, ps / pn) - real))) AS rmse_m,
              count(*) AS n_m
       FROM j WHERE real IS NOT NULL AND isfinite(real) GROUP BY ALL),
rep AS (SELECT te_col, avg(mae_m) AS mae, avg(rmse_m) AS rmse,
               CAST((SELECT count(DISTINCT time_key) FROM te) AS INTEGER) AS check_months,
               CAST(sum(n_m) AS BIGINT) AS rows_compared FROM pm GROUP BY te_col)"""

register(
    "audit_te",
    with_fb(AUDIT_TE, f"SELECT te_col, {r('mae')} AS mae, {r('rmse')} AS rmse, check_months, rows_compared FROM rep"),
)
register(
    "audit_flags",
    with_fb(AUDIT_TE, f"SELECT te_col, {r('mae')} AS mae, rows_compared FROM rep "
                      "WHERE mae > 1e-6 AND rows_compared > 0 ORDER BY rep.mae DESC, te_col LIMIT 5"),
)

# A4: stored rates (E6 over the loan view) against a recomputation over the
# train rows alone.
_stored = (
    ENC_BASE + "," + ",".join(past_rate_ctes(k) for k in PAST_RATE_KEYS) + ",\n"
    "stored AS (SELECT e.id, e.is_train, e.isDefault, e.time_key, "
    + ", ".join(f"e.{k}" for k in PAST_RATE_KEYS) + ", "
    + ", ".join(f"{past_rate_value(k, f't{i}')} AS hist_rate_{k}" for i, k in enumerate(PAST_RATE_KEYS))
    + " FROM enc_base e " + " ".join(past_rate_join(k, f"t{i}") for i, k in enumerate(PAST_RATE_KEYS))
    + "),\ntr AS (SELECT * FROM stored WHERE is_train = 1)"
)
_recomp = ",".join(past_rate_ctes(k, "tr").replace(f"pr_{k}", f"rc_{k}") for k in PAST_RATE_KEYS)
register(
    "audit_past_rate",
    "WITH " + _stored + "," + _recomp + ",\nlong AS ("
    + " UNION ALL ".join(
        f"SELECT 'hist_rate_{k}' AS hist_col, '{k}' AS key_col, "
        f"coalesce(q.rate, (SELECT gr FROM rc_{k}_gr)) AS mapped, CAST(tr.hist_rate_{k} AS DOUBLE) AS real "
        f"FROM tr LEFT JOIN rc_{k} q ON tr.{k} = q.k AND tr.time_key = q.m"
        for k in PAST_RATE_KEYS
    )
    + ")\nSELECT hist_col, key_col, " + r("avg(abs(mapped - real))") + " AS mae, "
    + r("sqrt(avg((mapped - real) * (mapped - real)))") + " AS rmse, count(*) AS rows_compared "
    "FROM long WHERE real IS NOT NULL AND isfinite(real) AND mapped IS NOT NULL GROUP BY ALL",
)

register(
    "monthly_auc",
    "WITH " + PREDS + ",\nmlong AS ("
    + " UNION ALL ".join(
        f"SELECT time_key, '{run}' AS col, isDefault AS y, CAST({run} AS DOUBLE) AS pred FROM pr_scores WHERE is_train = 1"
        for run in RUNS
    )
    + "),\nmn AS (SELECT time_key, col, count(*) AS n FROM mlong GROUP BY ALL),"
    + score_ctes("mlong", ["time_key", "col"]) + ",\na AS (" + auc_select(["time_key", "col"]) + ")\n"
    "SELECT mn.time_key, mn.col, " + r("a.auc") + " AS auc, mn.n FROM mn LEFT JOIN a USING (time_key, col)",
)

register(
    "last_n_months",
    "WITH " + ENC_BASE + "\nSELECT id, time_key FROM enc_base WHERE time_key >= "
    "(SELECT min(time_key) FROM (SELECT DISTINCT time_key FROM enc_base ORDER BY time_key DESC LIMIT 12))",
)
