"""Names queries and keeps their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import MATCH_SQL, ODDS_SQL, TOTALS_SQL

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, base: str = ""):
    """Register a function under ``name``; ``base`` puts fixture tables before the SQL: match, odds, totals or none."""
    head = {"match": f"WITH {MATCH_SQL}", "odds": f"WITH {ODDS_SQL}", "totals": f"WITH {TOTALS_SQL}", "": ""}[base]

    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            body = sql.strip()
            _SQL[name] = f"{head}, {body[5:]}" if head and body[:5].upper() == "WITH " else f"{head}\n{body}"
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
