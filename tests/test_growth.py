"""What a query does once for a graph is not done again for each question or row."""

import os
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.operators.graph import TripleStore
from quillgraph.plans import catalog, programs

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def told(spark):
    if not os.path.isdir(DIR):
        pytest.skip("no test tables here")
    return programs.graph(spark, DIR)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["catalog_teams", "catalog_agents", "catalog_tasks"])
def test_the_vocabulary_is_read_once_for_all_questions_and_nothing_is_sorted(spark, told, monkeypatch, name):
    monkeypatch.setattr(programs, "graph", lambda *_: told)
    read, own = [], catalog.detect
    monkeypatch.setattr(catalog, "detect", lambda t: read.append(t) or own(t))
    rows = programs.QUERIES[name](spark, DIR)
    assert len(read) == 1 and "rangepartitioning" not in plan(rows)


def test_questions_keep_their_order_unless_any_will_do(told):
    store = TripleStore(told.select("s", "p", "o"))
    first, second = (catalog.run(19, store, catalog.Vocabulary(), ordered=o) for o in (True, False))
    assert "rangepartitioning" in plan(first) and "rangepartitioning" not in plan(second)
    a, b = ([tuple(r) for r in rows.collect()] for rows in (first, second))
    assert sorted(a) == sorted(b) and a


def test_the_vocabulary_of_other_namespaces_is_found(spark):
    rows = [("<a>", "<urn:x/agentID>", '"1"'), ("<a>", "<urn:y#agentRole>", '"r"'), ("<b>", "<urn:x/agentID>", '"2"'), ("<a>", "<urn:z#hasTitle>", '"t"'), ("<a>", "<urn:w#other>", '"t"')]
    assert catalog.detect(spark.createDataFrame(rows, "s string, p string, o string")) == catalog.Vocabulary("urn:x/", "urn:z#")


def test_triples_lie_by_predicate(told):
    rows = told.select(F.input_file_name().alias("file"), "p").collect()
    changes = sum(a != b for a, b in zip(rows[:-1], rows[1:], strict=True))
    assert changes + 1 == len(set(rows)) and len({r.p for r in rows}) > 50


def test_a_function_is_walked_once(monkeypatch):
    import ast

    from quillgraph.operators import symbols

    source = "def f(state):\n    out = model.invoke([SystemMessage(content=P), HumanMessage(content=P)])\n    return {'out': out}\n"
    walked, own, tree = [], ast.walk, ast.parse(source)
    monkeypatch.setattr(symbols.ast, "walk", lambda n: walked.append(type(n)) or own(n))
    rows = symbols._File("a.py", tree).rows
    assert walked.count(ast.FunctionDef) == 1 and [r[0] for r in rows].count("function") == 1


def test_facts_are_parsed_once(spark):
    from quillgraph.operators.recover import Recovery
    from quillgraph.operators.symbols import kept_facts

    source = "KIT = [look]\nbase = ChatOpenAI(model='m')\ndef f(state):\n    return base.invoke('x')\n"
    found = kept_facts(spark.createDataFrame([("c", "a.py", source)], "system_id string, path string, source string"))
    kinds = [r.kind for r in found.collect()]
    r = Recovery(found)
    assert kinds == sorted(kinds) and {"value", "function"} <= set(kinds)
    assert all("from_json" not in plan(x) and "payload" not in x.columns for x in (r.values, r.functions, r.s.defined))
    assert {x.name for x in r.values.collect()} == {"KIT", "base", "f()"}


def test_parts_read_their_own_values_only(told):
    from quillgraph.operators.lower import KINDS, Lower, lowered

    own, whole = (Lower(told, catalog.Vocabulary(), kinds, kept=True).wide for kinds in (tuple(programs.PARTS), KINDS))
    assert "hasTitle" in own.columns and "promptInstruction" not in own.columns and 0 < own.count() < whole.count()
    few, all_of = lowered(told, kinds=tuple(programs.PARTS), kept=True), lowered(told)
    assert set(few) == set(programs.PARTS) and all(few[k].exceptAll(all_of[k]).isEmpty() and few[k].count() == all_of[k].count() for k in ("systems", "tools", "models"))


def test_texts_are_searched_as_they_lie_in_a_batch():
    from types import SimpleNamespace

    import pyarrow as pa

    from quillgraph.operators.compare import _inside

    batches = [pa.RecordBatch.from_pydict({"t": ["one two", "três bée"]}), pa.RecordBatch.from_pydict({"t": pa.array([], pa.string())})]
    found = [b.column("w").to_pylist() for b in _inside(SimpleNamespace(value=["two", "bé", "four"]))(iter(batches))]
    none = list(_inside(SimpleNamespace(value=[]))(iter(batches)))
    assert found == [["two", "bé"], []] and [b.num_rows for b in none] == [0, 0]


def test_a_triple_is_counted_without_cutting_names_out_of_it(spark):
    from quillgraph.functions import terms as T
    from quillgraph.operators.compare import property_usage

    terms = ["<a#x>", "<a>", "<a#>", "<ab>", "<b/y>", "<b>", "<c#z>", '"a#x"', '"<a#x"', "_:a#x", "<>", None]
    there = spark.createDataFrame([(t,) for t in terms], "t string").withColumn("in", T.in_namespaces(F.col("t"), ("a#", "b/")))
    assert [r.t for r in there.where("in").collect()] == ["<a#x>", "<a>", "<a#>", "<b/y>", "<b>"]
    assert not any(x in plan(there) for x in ("substring", "replace"))
    rows = [("g", "<s>", p, '"1"') for p in ("<a#n>", "<a#n>", "<b/n>", "<a#m>", "<c#n>")] + [("h", "<s>", "<a#n>", "<o>"), ("g", "<a#s>", "<a#n>", '"1"')]
    uses = property_usage(spark.createDataFrame(rows, "graph_id string, s string, p string, o string"), ("a#", "b/"))
    assert sorted(tuple(r) for r in uses.collect()) == [("g", "m", 1), ("g", "n", 3), ("h", "n", 1)]
    assert re.search(r"Aggregate \[graph_id#\d+, p#\d+\]", uses._jdf.queryExecution().optimizedPlan().toString())


def test_large_tables_of_symbols_are_dealt_out_and_not_sent_whole(spark, monkeypatch):
    from quillgraph.operators import closure, symbols
    from quillgraph.operators.recover import Recovery

    files = [(s, p, t) for s in ("a", "b") for p, t in (("m.py", f"base = ChatOpenAI(model='{s}')\nP = 'one'\n"), ("n.py", 'from m import *\narmed = base.bind_tools([look])\ndef f(state):\n    return {"x": armed.invoke([SystemMessage(content=P)])}\n'), ("g.py", "from n import *\ng = StateGraph(dict)\ng.add_node('f', f)\ng.add_edge('f', 'END')\n"))]
    found = symbols.kept_facts(spark.createDataFrame(files, "system_id string, path string, source string"))
    agents = lambda: sorted((r.system_id, r.agent_key, r.llm, tuple(r.tools), r.backstory) for r in Recovery(found).state_graphs()["agents"].collect())
    sent, plans, rounds, own = agents(), [], [], closure.checkpointed
    monkeypatch.setattr(closure, "MOST_SENT", 1)
    monkeypatch.setattr(symbols, "checkpointed", lambda df: plans.append(plan(df)) or own(df))
    monkeypatch.setattr(closure, "checkpointed", lambda df: rounds.append(plan(df)) or own(df))
    assert agents() == sent == [(s, "f", s, ("look",), "one") for s in "ab"]
    assert len(plans) >= 20 and not [re.findall(r"BroadcastHashJoin .*", p) for p in plans if "BroadcastHashJoin" in p]
    closure.transitive(spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(9)], "src string, dst string")).count()
    assert "BroadcastHashJoin" not in rounds[-4] and "SortMergeJoin" in rounds[-4]
