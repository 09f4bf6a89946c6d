"""Registry of queries: name -> (plan, SQL or None)."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
_PLANS: dict[str, tuple[Plan, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def keep(plan: Plan) -> Plan:
        if name in _PLANS:
            raise ValueError(f"query {name} is registered twice")
        _PLANS[name] = (plan, sql)
        return plan

    return keep


def queries() -> dict[str, Plan]:
    return {name: plan for name, (plan, _) in _PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _PLANS.items() if sql}
