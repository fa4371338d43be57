"""Every query that has SQL gives the rows that DuckDB gives for it."""

import datetime as dt
import math

import duckdb
import pytest

from attesta.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x.replace(tzinfo=None) if isinstance(x, dt.datetime) else x


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(value(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in catalogue.QUERIES.items() if sql))
def test_query_equals_its_sql(spark, db, name):
    f, sql = catalogue.QUERIES[name]
    df = f(spark, SF)
    got, want = df.collect(), db.execute(sql)
    names = [d[0] for d in want.description]
    got, want = rows(df.columns, got), rows(names, want.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert got[1], "no rows"
