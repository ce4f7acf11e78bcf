"""Every query that SQL can express equals DuckDB on the same tables; the rest keep their invariants."""

import math
import os

import duckdb
import pytest
from colloquy.registry import ORACLES, QUERIES

DATA = os.environ.get("COLLOQUY_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split() + ["labels"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return connection


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    wanted = duck.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows_of(found.columns, found.collect()) == rows_of(wanted.columns, wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
