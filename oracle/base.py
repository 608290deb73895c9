"""Shared SQL fragments for the DuckDB oracle."""

from __future__ import annotations

LOANS_CTE = """
li AS (
  SELECT l_orderkey,
         count(*) AS li_n,
         max(l_extendedprice) AS li_max_price,
         min(l_extendedprice) AS li_min_price,
         max(l_linenumber) AS li_max_line,
         max(l_discount) AS li_max_disc,
         max(l_tax) AS li_max_tax,
         min(l_partkey) AS li_min_part,
         min(l_suppkey) AS li_min_supp,
         CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS li_n_r,
         CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS li_n_a,
         CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS li_n_o,
         max(l_quantity) AS li_max_qty,
         min(l_quantity) AS li_min_qty
  FROM lineitem GROUP BY l_orderkey
),
cu AS (
  SELECT o_custkey AS cu_custkey, count(*) AS cu_n_orders, min(o_orderdate) AS cu_first_date
  FROM orders GROUP BY o_custkey
),
loans AS (
  SELECT o.o_orderkey AS id,
         CASE WHEN o.o_orderkey % 5 = 0 THEN 0 ELSE 1 END AS is_train,
         CASE WHEN 2 * li.li_n_r >= li.li_n THEN 1 ELSE 0 END AS isDefault,
         li.li_max_price AS loanAmnt,
         li.li_max_line AS term,
         li.li_max_disc * 100 AS interestRate,
         li.li_min_price AS installment,
         substr(o.o_orderpriority, 1, 1) AS grade,
         substr(o.o_orderpriority, 1, 1) || CAST(li.li_max_line AS VARCHAR) AS subGrade,
         CAST(li.li_min_part AS DOUBLE) AS employmentTitle,
         CASE WHEN c.c_custkey % 12 = 0 THEN NULL
              WHEN c.c_custkey % 12 = 1 THEN '< 1 year'
              WHEN c.c_custkey % 12 = 11 THEN '10+ years'
              ELSE CAST(c.c_custkey % 12 - 1 AS VARCHAR) || ' years' END AS employmentLength,
         o.o_orderstatus AS homeOwnership,
         c.c_acctbal AS annualIncome,
         strftime(o.o_orderdate, '%Y-%m') AS issueDate,
         c.c_mktsegment AS purpose,
         CAST(li.li_min_supp AS DOUBLE) AS postCode,
         c.c_nationkey AS regionCode,
         CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE li.li_max_tax * 100 END AS dti,
         CAST(600 + 10 * (p.p_size % 25) AS DOUBLE) AS ficoRangeLow,
         CAST(604 + 10 * (p.p_size % 25) AS DOUBLE) AS ficoRangeHigh,
         CAST(li.li_n AS DOUBLE) AS openAcc,
         p.p_retailprice AS revolBal,
         CASE WHEN o.o_custkey % 13 = 0 THEN NULL ELSE 2 * li.li_max_qty END AS revolUtil,
         CAST(cu.cu_n_orders AS DOUBLE) AS totalAcc,
         strftime(cu.cu_first_date, '%b-%Y') AS earliesCreditLine,
         CAST(p.p_size AS DOUBLE) AS title,
         1.0::DOUBLE AS policyCode,
         CAST(li.li_n AS DOUBLE) AS n0,
         CAST(li.li_n_r AS DOUBLE) AS n1,
         CASE WHEN li.li_n_a = 0 THEN NULL ELSE CAST(li.li_n_a AS DOUBLE) END AS n2,
         CAST(li.li_max_line AS DOUBLE) AS n3,
         CAST(li.li_n_o AS DOUBLE) AS n4,
         CASE WHEN li.li_min_qty > 40 THEN NULL ELSE li.li_min_qty END AS n5
  FROM orders o
  JOIN li ON o.o_orderkey = li.l_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN cu ON o.o_custkey = cu.cu_custkey
  JOIN part p ON p.p_partkey = li.li_min_part
),
sup AS (
  SELECT * REPLACE (CASE WHEN is_train = 1 THEN isDefault END AS isDefault) FROM loans
)"""


def with_loans(body: str) -> str:
    """Prepend the loans CTEs to a query that refers to ``loans`` / ``sup``.

    ``sup`` is the loan view with the target nulled on test rows. A body that
    starts with its own ``WITH`` is merged into the same CTE list.
    """
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return "WITH " + LOANS_CTE + ",\n" + body[5:]
    return "WITH " + LOANS_CTE + "\n" + body


def r(expr: str, digits: int = 6) -> str:
    """Round a double expression the same way the Spark side does."""
    return f"round(CAST({expr} AS DOUBLE), {digits})"


# ---- SQL twins of the column parsers (riskframe.functions.parse) ----------


def parse_date(s: str) -> str:
    """Same format order and two-digit-year pivot as the Spark parser."""
    t = f"trim(CAST({s} AS VARCHAR))"
    two_digit = (
        f"CASE WHEN regexp_full_match({t}, '[A-Za-z]{{3}}-[0-9]{{2}}') THEN "
        f"try_strptime(substr({t}, 1, 4) || CASE WHEN CAST(right({t}, 2) AS INTEGER) >= 69 "
        f"THEN '19' ELSE '20' END || right({t}, 2), '%b-%Y') END"
    )
    return (
        f"CAST(coalesce(try_strptime({t}, '%Y/%m/%d'), try_strptime({t}, '%Y-%m-%d'), "
        f"try_strptime({t}, '%Y-%m'), try_strptime({t}, '%Y/%m'), {two_digit}, "
        f"try_strptime({t}, '%b-%Y')) AS DATE)"
    )


def time_key(d: str) -> str:
    return f"CAST(coalesce(year({d}) * 100 + month({d}), 0) AS INTEGER)"


def postcode3(x: str) -> str:
    s = f"coalesce(CAST(CAST(trunc({x}) AS BIGINT) AS VARCHAR), '')"
    return f"(CASE WHEN length({s}) < 3 THEN lpad({s}, 3, '0') ELSE {s} END)"


def category_copy(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), 'nan')"


def hash_fold(id_expr: str, k: int) -> str:
    return f"CAST(('0x' || substr(md5(CAST({id_expr} AS VARCHAR)), 1, 8))::BIGINT % {k} AS INTEGER)"
