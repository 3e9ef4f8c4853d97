"""The registry of named queries: a Spark plan and, where SQL can say it, the same query for the oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

def complete(sql: str) -> str:
    from quarterloom.plans.base import SQL, ctes

    own = sql.lstrip()
    if own.startswith("WITH"):
        return sql
    used = [n for n in SQL if re.search(rf"(?:FROM|JOIN)\s+{n}\b", sql)]
    return (ctes(*used) + "\n" if used else "") + (own if used else own.lstrip(", "))


Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Registers a plan. SQL that names derived tables of ``base`` gets them as a WITH clause; if it
    brings further ones it begins with a comma."""

    def add(fn: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")
        PLANS[name] = fn
        if sql:
            ORACLE[name] = complete(sql)
        return fn

    return add
