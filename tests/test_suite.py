"""The driver's queries against their SQL twins on the smallest tables, on both kinds of store."""

import os

import pytest

from quillgraph.plans import functions, suite, texts

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for n in ("region nation customer supplier part orders lineitem events documents benchmark labels conversations").split():
        con.execute(f"create view {n} as select * from '{DIR}/{n}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(None if x is None or x != x else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r) for r in rows), key=repr)


QUERIES = {**suite.QUERIES, **functions.QUERIES, **texts.QUERIES}
ORACLES = {**suite.ORACLES, **functions.ORACLES, **texts.ORACLES}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    want = duck.execute(f"select {', '.join(f'\"{c}\"' for c in columns)} from ({ORACLES[name]})").fetchall()
    assert plain(got.select(*columns).collect()) == plain(want)


@pytest.mark.parametrize("name", ["bgp_star", "optional_left", "union_extend", "exists_marker", "path_plus"])
def test_triples_give_the_same(spark, name):
    a, b = (suite.QUERIES[name](spark, DIR, materialised=m) for m in (False, True))
    assert plain(a.collect()) == plain(b.collect())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_fuzzy_align_is_greedy_on_part_names(spark):
    from quillgraph.operators.align import similarity

    blocks = {}
    for r in spark.read.parquet(f"{DIR}/part.parquet").collect():
        blocks.setdefault(f"{r.p_brand}|{r.p_type}|{r.p_size}", []).append((str(r.p_partkey), r.p_name))
    want = set()
    for block, own in blocks.items():
        scored = sorted(((round(similarity(x, f"{y} land"), 3), j, i) for i, x in own for j, y in own if similarity(x, f"{y} land") >= 0.55), reverse=True)
        left, right = set(), set()
        for score, j, i in scored:
            if i not in left and j not in right:
                left.add(i)
                right.add(j)
                want.add((block, i, j, score))
    got = {(r.block.split("\x1f")[1], r.ref, r.cand, r.score) for r in suite.fuzzy_align(spark, DIR).collect()}
    assert got == want and len(want) > 100
