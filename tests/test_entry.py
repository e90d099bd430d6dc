import __spark_entry__ as entry_module


def test_contract_names_agree():
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 60


def test_entry_runs(spark):
    rows = entry_module.entry(spark)
    assert rows.count() > 0 and "priority" in rows.columns
