"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_point
from workload.fixtures import TABLES
from workload.oracles import ORACLES
from workload.queries import REGISTERED as QUERIES

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_SMALL}/{name}.parquet'")
    return connection


def comparable(value):
    if isinstance(value, float):
        return repr(round(value, 9))
    return repr(int(value)) if hasattr(value, "as_tuple") else repr(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(comparable(row[i]) for i in order) for row in rows)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry_point.queries()) and set(ORACLES) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    answer = duck.execute(ORACLES[name])
    expected = table([column[0] for column in answer.description], answer.fetchall())
    assert table(df.columns, df.collect()) == expected


def test_entry(spark):
    assert entry_point.entry(spark).count() == 6
