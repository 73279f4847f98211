"""Every query of the catalogue against its SQL, over the whole smallest tables."""

import glob
import os

import duckdb
import pytest

from graphmere.plans import catalogue


def database(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def compare(df, sql, con):
    cols = sorted(df.columns)
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
    assert got == sorted((tuple(plain(v) for v in r) for r in want), key=repr)


@pytest.fixture(scope="module")
def db(data):
    return database(data)


@pytest.mark.parametrize("name", list(catalogue.SQL))
def test_query(spark, data, db, name):
    compare(catalogue.QUERIES[name](spark, data), catalogue.SQL[name], db)


def test_every_query_runs(spark, data):
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
    for name in set(catalogue.QUERIES) - set(catalogue.SQL):
        assert catalogue.QUERIES[name](spark, data).count() > 0, name
