"""Query registry: a query is a function of (spark, folder) and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Plan], Plan]:
    """Register a query under its function name."""

    def add(plan: Plan) -> Plan:
        key = name or plan.__name__
        QUERIES[key] = plan
        if sql is not None:
            ORACLE[key] = sql
        return plan

    return add
