"""Oracle SQL for metrics, folds and sampling."""

from __future__ import annotations

from oracle import base as b
from oracle.base import r
from oracle.q_encode import ENC_BASE, past_rate_ctes, past_rate_join, past_rate_value
from oracle.queries import register

RUN_KEYS = {"hist_region": "regionCode", "hist_grade": "grade", "hist_purpose": "purpose",
            "hist_postcode": "postCode_cat"}
RUNS = list(RUN_KEYS) + ["open_share"]

PREDS = (
    ENC_BASE + "," + ",".join(past_rate_ctes(k) for k in RUN_KEYS.values()) + ",\n"
    "pr_scores AS (SELECT e.id, e.is_train, e.isDefault, e.time_key, "
    + ", ".join(f"{past_rate_value(k, f't{i}')} AS {run}" for i, (run, k) in enumerate(RUN_KEYS.items()))
    + ", (e.n4 + 1) / (e.n0 + 2) AS open_share FROM enc_base e "
    + " ".join(past_rate_join(k, f"t{i}") for i, k in enumerate(RUN_KEYS.values()))
    + "),\npreds AS ("
    + " UNION ALL ".join(
        f"SELECT '{run}' AS run, CASE WHEN is_train = 1 THEN 'oof' ELSE 'sub' END AS split, "
        f"id, isDefault AS y, CAST({run} AS DOUBLE) AS pred FROM pr_scores"
        for run in RUNS
    )
    + ")"
)


def score_ctes(src: str, by: list[str], name: str = "sc", label: str = "y") -> str:
    """Per (by, score): pos, neg, cnt and sums strictly below (name, name2)."""
    g = ", ".join(by)
    part = f"PARTITION BY {g} " if by else ""
    w = f"({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    lab = f"CAST({label} AS DOUBLE)" if label else "0.0"
    cond = f"isfinite(CAST(pred AS DOUBLE))" + (f" AND {label} IS NOT NULL" if label else "")
    return f"""
{name} AS (
  SELECT {g + ', ' if by else ''}CAST(pred AS DOUBLE) AS s, sum({lab}) AS pos, count(*) AS cnt
  FROM {src} WHERE {cond} GROUP BY ALL
),
{name}2 AS (
  SELECT *, cnt - pos AS neg,
    coalesce(sum(pos) OVER {w}, 0) AS pos_below,
    coalesce(sum(cnt - pos) OVER {w}, 0) AS neg_below,
    coalesce(sum(cnt) OVER {w}, 0) AS cnt_below
  FROM {name}
)"""


def auc_select(by: list[str], name: str = "sc") -> str:
    g = ", ".join(by)
    return (
        f"SELECT {g + ', ' if by else ''}"
        f"CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (neg_below + neg / 2.0)) / (sum(pos) * sum(neg)) END AS auc, "
        f"CAST(sum(cnt) AS BIGINT) AS n FROM {name}2 {'GROUP BY ' + g if by else ''}"
    )


OOF = "oof AS (SELECT * FROM preds WHERE split = 'oof')"

register(
    "auc",
    "WITH " + PREDS + "," + OOF + "," + score_ctes("oof", ["run"])
    + ", a AS (" + auc_select(["run"]) + ")\nSELECT run, " + r("auc") + " AS auc, n FROM a",
)
register(
    "model_auc",
    "WITH " + PREDS + "," + OOF + "," + score_ctes("oof", ["run"])
    + ", a AS (" + auc_select(["run"]) + ")\nSELECT run, " + r("auc")
    + " AS auc, CAST(row_number() OVER (ORDER BY auc DESC NULLS LAST, run) AS INTEGER) AS position FROM a",
)
register(
    "best_model",
    "WITH " + PREDS + "," + OOF + "," + score_ctes("oof", ["run"])
    + ", a AS (" + auc_select(["run"]) + ")\nSELECT run, " + r("auc") + " AS auc FROM a ORDER BY auc DESC NULLS LAST, run LIMIT 1",
)

register(
    "null_group_auc",
    "WITH " + PREDS + "," + OOF + ", og AS (SELECT * REPLACE (CASE WHEN run <> 'hist_grade' THEN run END AS run) FROM oof),"
    + score_ctes("og", ["run"]) + ", a AS (" + auc_select(["run"]) + ")\nSELECT run, " + r("auc") + " AS auc, n FROM a",
)

STRAT = """
sf_rows AS (SELECT id, y FROM oof WHERE run = 'open_share'),
sf AS (SELECT id, CAST((row_number() OVER (PARTITION BY y ORDER BY md5(CAST(id AS VARCHAR)), id) - 1) % 5 AS INTEGER) AS fold FROM sf_rows)"""

register(
    "fold_auc",
    "WITH " + PREDS + "," + OOF + "," + STRAT
    + ", j AS (SELECT oof.*, sf.fold FROM oof JOIN sf USING (id)),"
    + score_ctes("j", ["run", "fold"], "fa") + "," + score_ctes("oof", ["run"], "ov")
    + ", a AS (" + auc_select(["run", "fold"], "fa") + " UNION ALL SELECT run, -1 AS fold, auc, n FROM ("
    + auc_select(["run"], "ov") + "))\nSELECT run, fold, " + r("auc") + " AS auc, n FROM a",
)

register(
    "ks",
    "WITH " + PREDS + "," + OOF + "," + score_ctes("oof", ["run"])
    + ", t AS (SELECT run, sum(pos) AS P, sum(neg) AS N FROM sc2 GROUP BY run)\n"
    "SELECT run, " + r("max(CASE WHEN P > 0 AND N > 0 THEN (P - pos_below) / P - (N - neg_below) / N END)")
    + " AS ks FROM sc2 JOIN t USING (run) GROUP BY run",
)

register(
    "classification_report",
    "WITH " + PREDS + "," + OOF + """,
c AS (
  SELECT run,
    CAST(sum(CASE WHEN pred >= 0.5 AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
    CAST(sum(CASE WHEN pred >= 0.5 AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN pred < 0.5 AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
    CAST(sum(CASE WHEN pred < 0.5 AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn
  FROM oof WHERE y IS NOT NULL AND pred IS NOT NULL GROUP BY run
),
d AS (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision,
            CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall,
            (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM c
)
SELECT run, tp, fp, fn, tn, """
    + r("accuracy") + " AS accuracy, " + r("precision") + " AS precision, " + r("recall") + " AS recall, "
    + r("CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END") + " AS f1 FROM d",
)

register(
    "avg_rank",
    "WITH " + PREDS + "," + OOF + "," + score_ctes("oof", ["run"], label="")
    + "\nSELECT o.run, o.id, " + r("cnt_below + (cnt + 1) / 2.0")
    + " AS rank FROM oof o LEFT JOIN sc2 ON o.run = sc2.run AND CAST(o.pred AS DOUBLE) = sc2.s",
)

register(
    "minmax",
    "WITH " + PREDS + "," + OOF + ", mm AS (SELECT run, min(pred) AS mn, max(pred) AS mx FROM oof GROUP BY run)\n"
    "SELECT run, id, " + r("(pred - mn) / (mx - mn + 1e-12)") + " AS pred_mm FROM oof JOIN mm USING (run)",
)

register(
    "class_weight",
    "WITH c AS (SELECT CAST(sum(isDefault) AS BIGINT) AS pos, CAST(count(*) - sum(isDefault) AS BIGINT) AS neg "
    "FROM loans WHERE is_train = 1)\nSELECT pos, neg, " + r("neg / greatest(pos, 1)") + " AS scale_pos_weight FROM c",
)

register(
    "submission_clip",
    "WITH " + PREDS + "\nSELECT run, id, "
    + r("greatest(least(pred * 1.5::DOUBLE - 0.1::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE)")
    + " AS isDefault FROM preds WHERE split = 'sub'",
)

register("kfold_assign", f"SELECT id, {b.hash_fold('id', 5)} AS fold FROM loans WHERE is_train = 1")
register(
    "stratified_folds",
    "SELECT id, isDefault, CAST((row_number() OVER (PARTITION BY isDefault ORDER BY md5(CAST(id AS VARCHAR)), id) - 1) % 5 AS INTEGER) AS fold "
    "FROM loans WHERE is_train = 1",
)
register("hash_sample", "SELECT id, isDefault FROM loans ORDER BY md5(CAST(id AS VARCHAR)), id LIMIT 1000")
register(
    "stratified_sample",
    "SELECT id, isDefault FROM loans WHERE "
    "CAST(('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE < 0.2",
)
