"""Programs made of conversations: lifting, the 35 questions and lowering against SQL twins, row by row."""

import os

import pytest

from quillgraph.plans import programs

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def shared(spark):
    whole, own = programs.graph(spark, DIR), programs.graph
    programs.graph = lambda *_: whole  # lifted once for all tests; each query lifts for itself elsewhere
    yield
    programs.graph = own


@pytest.mark.parametrize("name", sorted(programs.ORACLES))
def test_program_query_matches_sql(spark, shared, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{DIR}/conversations.parquet'")
    got = programs.QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(f'\"{c}\"' for c in columns)} from ({programs.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want, key=repr) and want


def test_every_question_is_asked():
    asked = sorted(programs.AGENT_QUESTIONS + programs.TASK_QUESTIONS + programs.TEAM_QUESTIONS)
    assert asked == list(range(1, 36)) and set(programs.ORACLES) == set(programs.QUERIES)
