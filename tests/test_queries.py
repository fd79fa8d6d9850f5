"""Queries against their SQL on the smallest tables."""

import collections
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for f in os.listdir(FOLDER):
        connection.execute(f"create view {f[:-8]} as select * from '{FOLDER}/{f}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return tuple(plain(v) for v in value) if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if not (k[0] == "p" and k[1].isdigit())))
def test_query(spark, tables, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    want = tables.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    expected = collections.Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert collections.Counter(tuple(plain(v) for v in r) for r in df.select(*columns).collect()) == expected


@pytest.mark.parametrize("name", sorted(k for k in entry.queries() if k not in entry.oracle_sql() and not (k[0] == "p" and k[1].isdigit())))
def test_runs(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for f in os.listdir(FOLDER):
        spark.read.parquet(f"{FOLDER}/{f}").limit(0).write.parquet(str(folder / f))
    return str(folder)


@pytest.mark.parametrize("name", sorted(k for k in entry.queries() if not (k[0] == "p" and k[1].isdigit())))
def test_empty_tables(spark, empty, name):
    entry.queries()[name](spark, empty).collect()
