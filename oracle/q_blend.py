"""Oracle SQL for blending."""

from __future__ import annotations

import itertools

from oracle.base import r
from oracle.q_metrics import PREDS, RUNS, auc_select, score_ctes
from oracle.queries import register

WIDE = (
    PREDS + ",\nwide_all AS (SELECT split, id, min(y) AS y, "
    + ", ".join(f"max(CASE WHEN run = '{x}' THEN pred END) AS {x}" for x in RUNS)
    + ", count(DISTINCT run) AS nr FROM preds GROUP BY split, id),\n"
    f"wide AS (SELECT split, id, y, {', '.join(RUNS)} FROM wide_all WHERE nr = {len(RUNS)})"
)

register(
    "run_discovery",
    "WITH " + PREDS + "\nSELECT run, CAST(sum(CASE WHEN split = 'oof' THEN 1 ELSE 0 END) AS BIGINT) AS n_oof, "
    "CAST(sum(CASE WHEN split = 'sub' THEN 1 ELSE 0 END) AS BIGINT) AS n_sub FROM preds GROUP BY run",
)
register("prediction_align", "WITH " + WIDE + "\nSELECT split, id, y, " + ", ".join(f"{r(x)} AS {x}" for x in RUNS) + " FROM wide")
register("store_align", "WITH " + WIDE + "\nSELECT split, id, y, " + ", ".join(f"{r(x)} AS {x}" for x in RUNS) + " FROM wide")
register(
    "blend_mean",
    "WITH " + WIDE + "\nSELECT split, id, y, " + r(f"({' + '.join(RUNS)}) / {float(len(RUNS))!r}") + " AS pred FROM wide",
)


def _logit(x):
    p = f"least(greatest({x}, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE)"
    return f"ln({p} / (1 - {p}))"


register(
    "blend_logit_mean",
    "WITH " + WIDE + "\nSELECT split, id, y, "
    + r(f"1 / (1 + exp(-(({' + '.join(_logit(x) for x in RUNS)}) / {float(len(RUNS))!r})))")
    + " AS pred FROM wide",
)

RANKS = (
    WIDE + ",\nrl AS (" + " UNION ALL ".join(f"SELECT split, id, '{x}' AS run, {x} AS pred FROM wide" for x in RUNS)
    + ")," + score_ctes("rl", ["split", "run"], "rk", label="")
    + ",\nranks AS (SELECT rl.split, rl.id, rl.run, cnt_below + (cnt + 1) / 2.0 AS rank FROM rl "
    "JOIN rk2 ON rl.split = rk2.split AND rl.run = rk2.run AND CAST(rl.pred AS DOUBLE) = rk2.s)"
)
register(
    "blend_rank_mean",
    "WITH " + RANKS + ",\nrm AS (SELECT split, id, avg(rank) AS p FROM ranks GROUP BY split, id),\n"
    "mm AS (SELECT split, min(p) AS mn, max(p) AS mx FROM rm GROUP BY split)\n"
    "SELECT rm.split, rm.id, wide.y, " + r("(p - mn) / (mx - mn + 1e-12)")
    + " AS pred FROM rm JOIN mm USING (split) JOIN wide ON wide.split = rm.split AND wide.id = rm.id",
)
register(
    "spearman_matrix",
    "WITH " + RANKS + ",\nrw AS (SELECT id, "
    + ", ".join(f"max(CASE WHEN run = '{x}' THEN rank END) AS {x}" for x in RUNS)
    + " FROM ranks WHERE split = 'oof' GROUP BY id)\n"
    + " UNION ALL ".join(
        f"SELECT '{a}' AS run_a, '{b}' AS run_b, "
        + (r("1.0") + " AS rho" if a == b else r(f"corr({a}, {b})") + " AS rho FROM rw")
        for a in RUNS for b in RUNS
    ),
)

GRID_STEPS = 4
GRID = [tuple(x / GRID_STEPS for x in c) for c in itertools.product(range(GRID_STEPS + 1), repeat=len(RUNS))
        if sum(c) == GRID_STEPS]
VECS = "vecs AS (SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join([str(i)] + [f"{w!r}::DOUBLE" for w in ws]) + ")" for i, ws in enumerate(GRID)
) + ") v(vec, " + ", ".join(f"w{j}" for j in range(len(RUNS))) + "))"
_pred = " + ".join(f"w{j} * {x}" for j, x in enumerate(RUNS))
register(
    "blend_weight_search",
    "WITH " + WIDE + ",\n" + VECS + ",\ngs AS (SELECT vec, y, " + _pred + " AS pred FROM wide, vecs WHERE split = 'oof'),"
    + score_ctes("gs", ["vec"]) + ",\na AS (" + auc_select(["vec"]) + ")\n"
    "SELECT a.vec, " + ", ".join(f"w{j} AS w_{x}" for j, x in enumerate(RUNS)) + ", " + r("auc")
    + " AS auc FROM a JOIN vecs USING (vec) ORDER BY a.auc DESC NULLS LAST, a.vec LIMIT 1",
)
