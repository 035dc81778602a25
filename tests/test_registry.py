"""Every registered query with SQL gives the rows that the SQL gives."""

import os

import duckdb
import pytest

import __spark_entry__
from tests.conftest import TABLES
from typeloom import registry


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(TABLES):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, con, name):
    got = registry.QUERIES[name](spark, TABLES)
    wanted = con.sql(registry.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(wanted.columns)
    at = [wanted.columns.index(c) for c in columns]
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert mine == sorted((tuple(plain(r[i]) for i in at) for r in wanted.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_without_sql(spark, name):
    a, b = (sorted(map(tuple, registry.QUERIES[name](spark, TABLES).collect())) for _ in range(2))
    assert a == b and a


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_set_queries_read_whole_tables(spark):
    lines = spark.read.parquet(f"{TABLES}/lineitem.parquet").select("l_orderkey", "l_returnflag")
    got = registry.QUERIES["bag_difference"](spark, TABLES)
    assert got.count() == lines.filter("l_returnflag <> 'R'").count()
    assert got.agg({"l_orderkey": "max"}).first()[0] == lines.filter("l_returnflag <> 'R'").agg({"l_orderkey": "max"}).first()[0]
    names = {r[0] for t, c in (("supplier", "s_name"), ("customer", "c_name")) for r in spark.read.parquet(f"{TABLES}/{t}.parquet").select(c).collect()}
    assert sorted(r["name"] for r in registry.QUERIES["union_distinct"](spark, TABLES).collect()) == sorted(names)
