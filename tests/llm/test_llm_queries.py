"""The queries of the subpackage against their SQL, over the whole smallest tables."""

import glob
import os

import duckdb
import pytest

from graphmere.llm import catalogue


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, data, db, name):
    df = catalogue.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in catalogue.SQL:
        want = db.execute(f"SELECT {', '.join(cols)} FROM ({catalogue.SQL[name]})").fetchall()
        assert got == sorted((tuple(plain(v) for v in r) for r in want), key=repr)
    else:
        assert got
