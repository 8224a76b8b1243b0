"""Every flow query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from millrace import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}{'/*' if os.path.isdir(f'{SF}/{t}') else ''}'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
    want = con.execute(f"select {', '.join(cols)} from ({queries.SQL[name]})").fetchall()
    assert got == sorted(map(repr, want))
