"""The opN queries that have SQL twins, on the smallest tables."""

import os

import pytest

from quillgraph.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for name_of in ("documents", "labels"):
        con.execute(f"create view {name_of} as select * from '{DIR}/{name_of}.parquet'")
    got = QUERIES[name](spark, DIR)
    columns = ", ".join(sorted(got.columns))
    want = con.execute(f"select {columns} from ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.select(*sorted(got.columns)).collect())) == sorted(want)
