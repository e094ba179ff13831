"""The registry of core queries: name -> (plan, equivalent SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under its function's name, with the SQL that must give the same rows."""

    def add(plan: Plan) -> Plan:
        if plan.__name__ in QUERIES:
            raise ValueError(f"two queries are named {plan.__name__}")
        QUERIES[plan.__name__] = plan
        if sql:
            ORACLES[plan.__name__] = sql
        return plan

    return add
