"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from snarewatch.plans import registry
from snarewatch.sources.fixtures import BASE_TABLES

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for name in BASE_TABLES:
        db.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return db


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    found = QUERIES[name](spark, SMALL)
    columns = sorted(found.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    if name not in SQL:
        assert rows
        return
    said = duck.execute(SQL[name])
    names = [d[0] for d in said.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in said.fetchall())


def test_only_named_queries_have_sql():
    assert set(SQL) <= set(QUERIES)
