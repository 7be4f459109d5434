"""Every registered query with a SQL twin must agree with DuckDB, row for row."""

import math

import pytest

from conftest import SF
from kinframe.plans import all_queries
from kinframe.sources.fixtures import Views

QUERIES = all_queries()
SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def canonical(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value + 0.0:.6f}"
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(canonical(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_matches_sql(name, spark, duck):
    df = QUERIES[name].run(Views(spark, SF))
    got = table(df.columns, [tuple(r) for r in df.collect()])
    kinds = {r[0]: r[1] for r in duck.execute("DESCRIBE " + QUERIES[name].sql).fetchall()}
    assert {f.name: SQL_TYPES[f.dataType.simpleString()] for f in df.schema} == kinds
    cur = duck.execute(QUERIES[name].sql)
    want = table([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if not q.sql))
def test_runs(name, spark):
    assert QUERIES[name].run(Views(spark, SF)).count() > 0
