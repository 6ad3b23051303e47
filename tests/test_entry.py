import __spark_entry__ as registered


def test_every_sql_counterpart_has_a_query():
    queries, statements = registered._REGISTRY, registered.oracle_sql()
    assert set(statements) <= set(registered.queries())
    assert set(queries) <= set(statements)


def test_entry(spark):
    rows = registered.entry(spark).collect()
    assert sum(r["invoices"] for r in rows) == 1500
