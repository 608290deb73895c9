"""Oracle SQL for components and dependencies (DuckDB dialect)."""

from __future__ import annotations

from oracle import base as b
from oracle.base import r
from oracle.queries import register

COLS = ["n0", "n1", "n2", "n3", "n4", "n5"]
DEPENDENCIES = [("postCode_cat", "regionCode"), ("subGrade", "grade"), ("purpose", "homeOwnership"), ("regionCode", "grade")]

SCALED = (
    "m AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}" for c in COLS) + " FROM loans),\n"
    "f AS (SELECT " + ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in COLS) + " FROM loans, m),\n"
    "s AS (SELECT " + ", ".join(f"stddev_pop({c}) AS s_{c}" for c in COLS) + " FROM f),\n"
    "z AS (SELECT " + ", ".join(f"CASE WHEN s_{c} > 1e-12 THEN ({c} - m_{c}) / s_{c} ELSE 0.0::DOUBLE END AS {c}" for c in COLS) + " FROM f, m, s)"
)
register(
    "pca_gram",
    f"WITH {SCALED}\n"
    + " UNION ALL ".join(f"SELECT '{x}' AS col_a, '{y}' AS col_b, {r(f'avg({x} * {y})')} AS value FROM z" for i, x in enumerate(COLS) for y in COLS[i:]),
)
register("pca_variance", f"WITH {SCALED}\nSELECT count(*) AS n_rows, " + r(" + ".join(f"var_pop({c})" for c in COLS)) + " AS variance FROM z")

KEYS = f"""
d AS (SELECT *, {b.postcode3('postCode')} AS postCode_cat FROM sup),
p AS ({' UNION ALL '.join(f"SELECT '{x}' AS lhs, '{y}' AS rhs, CAST({x} AS VARCHAR) AS key, CAST({y} AS VARCHAR) AS value FROM d" for x, y in DEPENDENCIES)}),
c AS (SELECT lhs, rhs, key, value, count(*) AS n FROM p WHERE key IS NOT NULL GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY lhs, rhs, key ORDER BY n DESC, value NULLS LAST) AS k,
             sum(n) OVER (PARTITION BY lhs, rhs, key) AS rows, count(*) OVER (PARTITION BY lhs, rhs, key) AS n_values FROM c),
keyed AS (SELECT lhs, rhs, key, CAST(rows AS BIGINT) AS rows, n_values, value, n AS kept FROM o WHERE k = 1)"""
register(
    "dependency_errors",
    f"WITH {KEYS}\nSELECT lhs, rhs, CAST(sum(rows) AS BIGINT) AS rows, count(*) AS n_keys, "
    f"count(*) FILTER (n_values > 1) AS n_conflicts, {r('1 - sum(kept) / sum(rows)')} AS g3 FROM keyed GROUP BY lhs, rhs",
)
register("dependency_conflicts", f"WITH {KEYS}\nSELECT *, {r('1 - kept / rows')} AS off_share FROM keyed WHERE n_values > 1")
