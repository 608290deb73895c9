"""Oracle SQL per query key (DuckDB dialect)."""

from __future__ import annotations

from oracle import base as b
from oracle.base import r, with_loans

ORACLE: dict[str, str] = {}


def register(name: str, body: str) -> None:
    if name in ORACLE:
        raise ValueError(f"duplicate oracle {name}")
    ORACLE[name] = with_loans(body)


def oracle_sql() -> dict[str, str]:
    # Import for side effects: each module registers its oracle texts.
    from oracle import q_audit, q_blend, q_encode, q_features, q_metrics, q_parse, q_report, q_shape  # noqa: F401

    return dict(ORACLE)


__all__ = ["ORACLE", "oracle_sql", "register", "b", "r"]
