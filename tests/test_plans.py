"""Every plan with SQL against DuckDB over the smallest tables, as values and as types."""

from datetime import datetime
from pathlib import Path

import duckdb
import pytest

from tarn.plans import library

KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double", "DATE": "date"}
PLAIN, SQL = library.queries(), library.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in Path(sf).iterdir():
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(rows):
    day = lambda v: v.date() if isinstance(v, datetime) and not (v.hour or v.minute or v.second) else v
    return sorted(str(tuple(map(day, r))) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_plan_equals_sql(spark, sf, duck, name):
    df = PLAIN[name](spark, sf)
    found = duck.execute(SQL[name])
    kinds = {c[0]: str(c[1]) for c in found.description}
    columns = sorted(kinds)
    assert sorted(df.columns) == columns
    assert {c: KINDS[k] for c, k in kinds.items()} == dict(df.dtypes)
    at = [list(kinds).index(c) for c in columns]
    assert plain(df.select(columns).collect()) == plain([[r[i] for i in at] for r in found.fetchall()])


@pytest.mark.parametrize("name", sorted(set(PLAIN) - set(SQL)))
def test_plan_without_sql_runs(spark, sf, name):
    assert PLAIN[name](spark, sf).count() > 0
