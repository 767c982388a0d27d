"""Every query of the retrieval-evaluation operators against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from haystrata.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    rows = sorted(map(str, (tuple(r) for r in got.select(*cols).collect())))
    if name in catalog.SQL:
        want = con.execute(catalog.SQL[name])
        names = [x[0] for x in want.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert rows == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())
    else:
        assert rows
