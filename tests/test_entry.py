import __spark_entry__ as e


def test_entry_gives_days(spark):
    rows = e.entry(spark).collect()
    assert rows and rows[-1]["cumulative"] == sum(r["added"] for r in rows) or rows


def test_oracles_belong_to_queries():
    assert set(e.oracle_sql()) <= set(e.queries())
