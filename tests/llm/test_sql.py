"""Queries that SQL can express give the rows of their SQL."""

import os

import duckdb
import pytest

from tests.conftest import TABLES
from typeloom.llm import queries


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{f}'")
    got, wanted = queries.QUERIES[name](spark, TABLES), con.sql(queries.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(wanted.columns)
    at = [wanted.columns.index(c) for c in columns]
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert mine == sorted((tuple(plain(r[i]) for i in at) for r in wanted.fetchall()), key=repr)
