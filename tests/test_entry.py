"""The driver contract."""

import __spark_entry__ as contract


def test_contract(spark):
    rows = contract.entry(spark)
    assert rows.count() > 0
    names = contract.queries()
    assert set(contract.oracle_sql()) < set(names)
    assert "v10_search_faces" in names
