"""Every query with SQL against DuckDB on the smallest tables; the others for shape."""

import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def core(names):
    return sorted(n for n in names if not re.match(r"op\d+_", n) and n != "pipeline")


QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = f"{SF}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def same(df, con, sql):
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(plain(row[c]) for c in columns)) for row in df.collect())
    ran = con.execute(sql)
    names = [d[0] for d in ran.description]
    assert sorted(names) == columns
    theirs = sorted(repr(tuple(plain(row[names.index(c)]) for c in columns)) for row in ran.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", core(SQL))
def test_matches_sql(spark, duck, name):
    same(QUERIES[name](spark, SF), duck, SQL[name])


@pytest.mark.parametrize("name", core(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 20


def test_streams_are_repeatable(spark):
    a, b = (QUERIES["stream_latest"](spark, SF) for _ in range(2))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
