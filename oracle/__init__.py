"""Independent DuckDB oracle queries, one per checked query key.

Each query is written against the driver's raw tables; the ``loans`` view is a
common table expression prepended by :func:`with_loans`.
"""

from oracle.queries import ORACLE, oracle_sql  # noqa: F401
