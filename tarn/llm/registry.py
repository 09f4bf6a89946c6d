"""The subpackage's queries, and the SQL of those that SQL can express on whole tables."""

from tarn.llm.plans import ORACLES, PLANS


def queries() -> dict:
    return dict(PLANS)


def oracle_sql() -> dict:
    return dict(ORACLES)
