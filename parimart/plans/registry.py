"""Registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from .bindings import SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(tables)``. ``sql`` may use the domain views by name; they are put before it as CTEs."""

    def wrap(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(ship(spark), sf_dir))
        if sql is not None:
            used = [v for v in SQL if v in sql or v == "starts" and "payouts" in sql]
            body = sql.strip()
            ctes = ", ".join(f"{v} as ({SQL[v]})" for v in used)
            if ctes:
                body = f"with {ctes}, {body[4:]}" if body.lower().startswith("with") else f"with {ctes} {body}"
            ORACLE_SQL[name] = body
        return f

    return wrap
