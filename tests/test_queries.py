"""Every registered query against its SQL in DuckDB, at the smallest scale factor."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, datetime.datetime) and (v.hour, v.minute, v.second) == (0, 0, 0):
        return v.date()
    return v


def bag(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows), sorted(names)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert bag(rows, df.columns) == bag(got.fetchall(), names)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_optional_modules_may_be_absent(monkeypatch):
    assert entry._optional("corpusmill.no_such_package", "QUERIES") == {}
    with pytest.raises(AttributeError):
        entry._optional("corpusmill.catalog", "NO_SUCH")
