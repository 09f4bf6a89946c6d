"""Queries with SQL, against DuckDB over whole tables."""

from pathlib import Path

import duckdb
import pytest

from tarn.llm import registry

KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in Path(sf).iterdir():
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    found = duck.execute(registry.oracle_sql()[name])
    kinds = {c[0]: KINDS[str(c[1])] for c in found.description}
    assert kinds == dict(df.dtypes)
    assert sorted(map(str, df.select(list(kinds)).collect())) == sorted("Row(" + ", ".join(f"{k}={v!r}" for k, v in zip(kinds, r, strict=True)) + ")" for r in found.fetchall())


def test_all_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))
