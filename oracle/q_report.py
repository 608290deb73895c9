"""Oracle SQL for EDA and result reports."""

from __future__ import annotations

from oracle.base import r
from oracle.q_metrics import OOF, PREDS, STRAT, auc_select, score_ctes
from oracle.queries import register

register(
    "rate_by_grade",
    f"SELECT grade, count(*) AS n, {r('avg(isDefault)')} AS default_rate FROM loans WHERE is_train = 1 GROUP BY grade",
)
register("count_by_grade", "SELECT grade, count(*) AS n FROM loans GROUP BY grade")
register(
    "histogram",
    """
WITH v AS (SELECT ln(1 + greatest(CAST(annualIncome AS DOUBLE), 0.0)) AS v FROM loans),
f AS (SELECT v FROM v WHERE v IS NOT NULL AND isfinite(v)),
mm AS (SELECT min(v) AS lo, max(v) AS hi FROM f),
w AS (SELECT lo, CASE WHEN hi > lo THEN (hi - lo) / 50 ELSE 1.0 END AS width FROM mm),
b AS (SELECT CAST(least(floor((v - lo) / width), 49) AS INTEGER) AS bin, lo, width FROM f, w)
SELECT bin, """ + r("lo + bin * width") + " AS lo, " + r("lo + (bin + 1) * width") + " AS hi, count(*) AS n FROM b GROUP BY bin, lo, width",
)

RESULTS = (
    PREDS + "," + OOF + "," + STRAT
    + ", j AS (SELECT oof.*, sf.fold FROM oof JOIN sf USING (id)),"
    + score_ctes("j", ["run", "fold"], "fa")
    + ", fa3 AS (" + auc_select(["run", "fold"], "fa") + "),\n"
    "results AS (SELECT run AS model, split_part(run, '_', 1) AS family, fold AS version, auc FROM fa3)"
)
register(
    "improvement_vs_baseline",
    "WITH " + RESULTS + "\nSELECT model, version, " + r("auc") + " AS auc, "
    + r("(auc - (SELECT min(auc) FROM results)) * 10000") + " AS improvement_bp FROM results",
)
register(
    "fe_delta",
    "WITH " + RESULTS + ", base AS (SELECT model, auc AS b FROM results WHERE version = 0)\n"
    "SELECT model, version, " + r("auc") + " AS auc, " + r("auc - b") + " AS delta FROM results LEFT JOIN base USING (model)",
)
register(
    "best_results",
    "WITH " + RESULTS + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY auc DESC, version) AS rk FROM results)\n"
    "SELECT model, family, version AS best_version, " + r("auc") + " AS auc, " + r("auc - 0.71") + " AS vs_reference FROM ranked WHERE rk = 1",
)
register(
    "result_averages",
    "WITH " + RESULTS + ", g AS (SELECT family, version, avg(auc) AS auc, count(*) AS n FROM results GROUP BY ALL)\n"
    "SELECT 'family' AS by, family AS value, " + r("sum(auc * n) / sum(n)") + " AS avg_auc FROM g GROUP BY family "
    "UNION ALL SELECT 'version' AS by, CAST(version AS VARCHAR) AS value, " + r("sum(auc * n) / sum(n)") + " AS avg_auc FROM g GROUP BY version",
)
