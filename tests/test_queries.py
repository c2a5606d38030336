"""Every query outside the llm subpackage against its SQL, over the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from tesserae.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents pages".split():
        path = f"{DIR}/{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*' if os.path.isdir(path) else ''}'")
    return connection


def ordered(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([r[i] for i in at] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sql, name):
    df = registry.QUERIES[name](spark, DIR)
    got = ordered(map(tuple, df.collect()), df.columns)
    assert got
    if name in registry.ORACLES:
        result = sql.execute(registry.ORACLES[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(df.columns) and got == ordered(result.fetchall(), columns)


def test_oracles_belong_to_queries():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
