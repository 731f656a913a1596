"""Every core query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lodewatch.plans import catalog as queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        out.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return out


def ordered(rows, columns):
    names = sorted(columns)
    return sorted((tuple(r[columns.index(c)] for c in names) for r in rows), key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_same_as_sql(spark, con, name):
    got = queries.QUERIES[name](spark, DATA)
    found = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(got.columns)
    expected = found.fetchall()
    assert ordered([tuple(r) for r in got.collect()], got.columns) == ordered(expected, columns)
    assert expected
