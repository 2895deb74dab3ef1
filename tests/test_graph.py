import pytest
from pyspark.sql import functions as F

from quillgraph.functions import terms as T
from quillgraph.operators import algebra, align, compare, graph, workflow
from quillgraph.operators.closure import transitive
from quillgraph.operators.graph import Mapping, Pattern, TableStore, TripleStore, Var
from quillgraph.plans import catalog, sparql
from quillgraph.sources import turtle

EX = "http://ex/"
TTL = '''
@prefix : <http://ex/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
# a comment
:a a :Agent ; :name "A \\"one\\""@en , """long
text""" ; :n 7 , 1.5 , true ; :knows [ :name "blank" ] ; :list ( 1 :b ) .
:a a :Agent .
:b :name "x"^^xsd:string .
'''


def triples(spark, rows, graph_id="g"):
    return spark.createDataFrame([(graph_id, *r) for r in rows], graph.TRIPLE_SCHEMA)


def q(text):
    return sparql.parse("PREFIX : <http://ex/> " + text)


def answers(spark, rows, text):
    out = algebra.evaluate(q(text), TripleStore(triples(spark, rows).select("s", "p", "o")))
    return sorted((tuple(r) for r in out.collect()), key=repr)


def e(*names):
    return tuple(f"<{EX}{n}>" for n in names)


def test_turtle_terms_scopes_and_errors(spark):
    got = turtle.parse(TTL, "f1")
    assert len(got) == len(set(got)) == 14
    assert (f"<{EX}b>", f"<{EX}name>", '"x"') in got and (f"<{EX}a>", f"<{EX}n>", T.literal("7", T.XSD + "integer")) in got
    assert any(o == '"A \\"one\\""@en' for _, _, o in got) and any("long\\ntext" in o for _, _, o in got)
    docs = spark.createDataFrame([("x", TTL), ("y", "@prefix : <http://ex/> . :a :b"), ("z", None)], "graph_id string, text string")
    rows = turtle.parsed(docs).collect()
    assert sum(r.error is not None for r in rows) == 1 and sum(r.s is not None for r in rows) == 14
    back = turtle.written(turtle.parsed(docs).where("error is null").drop("error")).first().text
    assert {x for x in turtle.parse(back) if "_:" not in x[0] + x[2]} == {x for x in got if "_:" not in x[0] + x[2]}
    turtle.register(spark)
    assert spark.read.format("turtle").option("text", TTL).load().count() == 14


def test_terms_read_back(spark):
    rows = [T.iri("http://ex/a#b/c"), '"a\\\\n\\"b\\n"@en', T.literal("5", T.XSD + "integer"), "_:x1"]
    df = spark.createDataFrame([(r,) for r in rows], "t string").select(T.lexical(F.col("t")), T.lang(F.col("t")), T.datatype(F.col("t")), T.local_name(F.col("t")), T.reader_name(F.col("t")))
    got = [tuple(r) for r in df.collect()]
    assert got[0] == ("http://ex/a#b/c", None, None, "c", "b/c") and got[1][:3] == ('a\\n"b\n', "en", None) and got[2][:3] == ("5", None, T.XSD + "integer") and got[3][0] == "x1"


def test_patterns_optional_union_filters(spark):
    a, b, c, knows, name = e("a", "b", "c", "knows", "name")
    rows = [(a, knows, b), (a, knows, c), (b, name, '"B"'), (b, name, '"Bee"'), (a, T.TYPE, e("Agent")[0])]
    assert len(answers(spark, rows, "SELECT ?x ?n WHERE { ?x :knows ?y . OPTIONAL { ?y :name ?n } }")) == 3
    assert answers(spark, rows, "SELECT ?y WHERE { ?x :knows ?y . FILTER NOT EXISTS { ?y :name ?n } }") == [(c,)]
    assert answers(spark, rows, "SELECT ?y WHERE { ?x :knows ?y . FILTER(?y != :b) }") == [(c,)]
    marked = answers(spark, rows, 'SELECT ?y (IF(EXISTS { ?y :name ?z }, "y", "n") AS ?has) WHERE { ?x :knows ?y }')
    assert marked == [(b, '"y"'), (c, '"n"')]
    both = answers(spark, rows, 'SELECT ?v ?k WHERE { { ?v :knows ?w . BIND("k" AS ?k) } UNION { ?v :name ?w } }')
    assert len(both) == 4 and (b, None) in both
    assert answers(spark, rows, 'SELECT ?n WHERE { :b :name ?n . FILTER(REGEX(?n, "BEE", "i")) }') == [('"Bee"',)]
    assert answers(spark, rows, "SELECT ?n WHERE { :a :knows/:name ?n }") == [('"B"',), ('"Bee"',)]
    for bad in ("SELECT DISTINCT ?x WHERE { ?x :p ?y }", "SELECT ?x WHERE { ?x :p ?y } LIMIT 3", "SELECT ?x WHERE { ?x :p* ?y }", "SELECT ?x { ?x nope:p ?y }"):
        with pytest.raises(ValueError):
            q(bad)


def test_order_puts_numbers_by_value(spark):
    rows = [(e("s")[0], e("p")[0], T.literal(n, T.XSD + "integer")) for n in ("10", "9", "-1")] + [(e("s")[0], e("p")[0], x) for x in (e("z")[0], "_:b", '"a"')]
    out = algebra.evaluate(q("SELECT ?o WHERE { ?s :p ?o } ORDER BY ?o"), TripleStore(triples(spark, rows).select("s", "p", "o")))
    assert [r.o for r in out.collect()][:2] == ["_:b", e("z")[0]] and [T_ for r in out.collect() if (T_ := r.o[1:3]) in ("-1", "9\"", "10")] == ["-1", '9"', "10"]


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), (None, "x")] + [(f"n{k}", f"n{k + 1}") for k in range(20)], "src string, dst string")
    got = {tuple(r) for r in transitive(edges).collect()}
    assert {(x, y) for x in "abc" for y in "abc"} <= got and ("d", "d") in got and len(got) == 9 + 1 + 210
    assert transitive(edges.limit(0)).count() == 0


def test_both_stores_agree(spark):
    t = {"c": spark.createDataFrame([(1, "x", 10), (2, None, 20)], "k int, name string, n int"), "n": spark.createDataFrame([(10, "N")], "k int, name string")}
    s = TableStore(t, {"c": Mapping(("k",), {"n": "n"}), "n": Mapping(("k",))})
    star = [Pattern(Var("c"), "<c#name>", Var("x")), Pattern(Var("c"), "<c#n>", Var("n")), Pattern(Var("n"), "<n#name>", Var("y"))]
    want = [("<c/1>", '"x"', "<n/10>", '"N"')]
    for store in (s, TripleStore(s.materialised()), TripleStore(s.materialised(), frozenset(("<c#name>", "<c#n>")))):
        assert [tuple(r[c] for c in ("c", "x", "n", "y")) for r in store.bgp(star).collect()] == want


def test_pairwise_scores(spark):
    v = ("http://v/",)
    ref = [("<http://ex/a>", T.TYPE, "<http://v/Agent>"), ("<http://ex/a>", "<http://v/name>", '"One  Two"'), ("<http://ex/b>", T.TYPE, "<http://v/Agent>"), ("<http://v/Agent>", T.TYPE, f"<{T.OWL}Class>")]
    cand = [("<http://ex/z>", T.TYPE, "<http://v/Agent>"), ("<http://ex/z>", "<http://v/name>", '"one two"')]
    both = triples(spark, ref, "r").union(triples(spark, cand, "c"))
    pairs = spark.createDataFrame([("same", "r", "r"), ("p", "r", "c"), ("q", "c", "r")], "pair_id string, ref_id string, cand_id string")
    got = {r.pair_id: r for r in compare.pairwise(both, pairs, v).collect()}
    assert all(got["same"][c] == 1.0 for c in got["same"].asDict() if c != "pair_id")
    assert (got["p"].individual_precision, got["p"].individual_recall) == (1.0, 0.5) == (got["q"].individual_recall, got["q"].individual_precision)
    assert got["p"].triple_f1 == 0.0 and got["p"].literal_overlap == 1.0
    scores = {r.pair_id: r for r in align.aligned_scores(both, pairs, v).collect()}
    assert scores["p"].aligned == 1 and scores["p"].precision == 0.5 and scores["same"].f1 == 1.0
    counts = compare.intrinsic(both, v).where("graph_id = 'r'").first()
    assert (counts.triples, counts.abox_triples, counts.individuals, counts.properties, counts.literals) == (4, 3, 2, 1, 1)


def test_greedy_is_what_one_by_one_takes(spark):
    import random

    rnd = random.Random(1)
    rows = [("x", f"r{a:02}", f"c{b:02}", rnd.randint(1, 5) / 5) for a in range(15) for b in range(15) if rnd.random() < 0.4]
    want, left, right = set(), set(), set()
    for _, a, b, _s in sorted(rows, key=lambda r: (-r[3], r[2], r[1])):
        if a not in left and b not in right:
            want.add((a, b))
            left.add(a)
            right.add(b)
    got = align.greedy(spark.createDataFrame(rows, "pair_id string, ref string, cand string, score double"))
    assert {(r.ref, r.cand) for r in got.collect()} == want


def test_fuzzy_and_macro_scores(spark):
    assert align.similarity("Search_Tool", "search tool") == 1.0 and align.similarity("", "x") == 0.0 and 0.5 < align.similarity("web search", "search the web") < 1
    features = spark.createDataFrame([("a", "f", "1"), ("a", "f", "2"), ("b", "f", "1"), ("a", "g", "1")], "graph_id string, feature string, value string")
    pairs = spark.createDataFrame([("p", "a", "b")], "pair_id string, ref_id string, cand_id string")
    r = compare.macro_scores(features, pairs).first()
    assert (r.overall_precision, r.overall_recall) == (0.5, 0.25)


def test_workflow_rules(spark):
    steps = spark.createDataFrame([("w", "a", [], ["go"], None, "start"), ("w", "b", ["go"], [], None, "regular"), ("w", "c", ["b"], [], None, "regular")], "flow string, name string, dependencies array<string>, return_values array<string>, outgoing array<string>, step_type string")
    edges = workflow.resolved_edges(steps)
    assert {(r.src, r.dst) for r in edges.collect()} == {("a", "b"), ("b", "c")}
    assert {r.name for r in workflow.end_kinds(steps, edges).where("ends").collect()} == {"c"}
    kinds = spark.createDataFrame([("w", "a", "agent", False), ("w", "t", "tool", False)], "flow string, name string, kind string, dynamic boolean")
    fan = spark.createDataFrame([("w", "a", "t", True), ("w", "a", "END", True)], "flow string, src string, dst string, conditional boolean")
    assert workflow.topology(kinds, fan).first().pattern == "ReActLoop" and workflow.topology(kinds, fan.limit(0)).first().pattern == "Sequential"


def test_catalog_answers_small_graph(spark):
    v = catalog.Vocabulary()
    rows = [("<u:a>", T.TYPE, v("LLMAgent")), ("<u:a>", v("agentRole"), '"User proxy"'), ("<u:a>", v("agentPrompt"), "<u:p1>"), ("<u:a>", v("agentPrompt"), "<u:p2>"), ("<u:t>", v("containsTeam"), "<u:s>"), ("<u:s>", v("orchestratesTeam"), "<u:t>"), ("<u:t>", T.TYPE, v("Team")), ("<u:s>", T.TYPE, v("Team"))]
    t = triples(spark, rows)
    assert catalog.run(7, t, v).count() == 2 and catalog.run(10, t, v).first().classification == '"human-proxy"' and catalog.run(22, t, v).count() == 4
    assert [catalog.run(n, t, v).columns for n in (1, 35)] == [["system", "agent"], ["task", "checkpoint", "position", "checkpointType", "mandatory"]]
    with pytest.raises(ValueError):
        catalog.question(36, v)


def test_unbound_variables_match_anything(spark):
    """Rows of optional parts against a brute-force evaluation: a variable that is unbound is compatible with all."""
    from quillgraph.operators.algebra import bindings, evaluate
    from quillgraph.operators.graph import TripleStore
    from quillgraph.plans.sparql import parse

    rows = [("<a>", "<p>", "<x>"), ("<b>", "<p>", "<y>"), ("<c>", "<q>", "<x>"), ("<x>", "<n>", '"1"'), ("<y>", "<n>", '"2"'), ("<z>", "<n>", '"3"')]
    store = TripleStore(spark.createDataFrame(rows, "s string, p string, o string"))
    ask = lambda q: sorted(evaluate(parse(q), store).collect(), key=repr)
    got = ask("SELECT ?s ?v ?k WHERE { { ?s <p> ?w } UNION { ?s <q> ?w } OPTIONAL { ?s <p> ?v } OPTIONAL { ?v <n> ?k } }")
    assert [tuple(r) for r in got] == [("<a>", "<x>", '"1"'), ("<b>", "<y>", '"2"'), ("<c>", "<x>", '"1"'), ("<c>", "<y>", '"2"'), ("<c>", "<z>", '"3"')]
    pairs = ask("SELECT ?a ?b WHERE { ?a <p> <x> . ?b <q> <x> }")
    assert [tuple(r) for r in pairs] == [("<a>", "<c>")]
    sure, maybe = bindings(parse("SELECT ?s ?v ?k WHERE { ?s <p> ?w OPTIONAL { ?s <n> ?v } }"))
    assert sure == {"s"} and maybe == {"v", "k"}


def test_all_pairs_are_dealt_out_by_the_larger_side(spark):
    """An OPTIONAL without a shared variable: the few rows are sent to the many, not the many to one task's rows."""
    from quillgraph.operators.graph import joined

    few, many = spark.range(3).selectExpr("cast(id as string) x"), spark.range(0, 5000, 1, 4).selectExpr("cast(id as string) y")
    out = joined(few, many, "left")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "LeftOuter" not in plan and "BuildLeft, Cross" in plan
    assert out.columns == ["x", "y"] and out.count() == 15000 and out.distinct().count() == 15000
    assert {tuple(r) for r in joined(few, many.where("y = 'none'"), "left").collect()} == {(str(k), None) for k in range(3)}
    assert joined(few.limit(0), many, "left").count() == 0


def test_all_pairs_are_made_of_finished_rows(spark):
    """What is made of each column is made once a row of either side, and pairs are not planned one by one."""
    from quillgraph.operators.graph import BLOCK_ROWS
    from quillgraph.plans.suite import MAPPINGS, ask

    n = BLOCK_ROWS + 44
    t = {"customer": spark.createDataFrame([(k, "n") for k in range(n)], "c_custkey long, c_name string"), "orders": spark.createDataFrame([(1, 0, 'a "b" \\n'), (2, 0, None), (3, None, "c"), (4, 7, "d\te")], "o_orderkey long, o_custkey long, o_orderpriority string")}
    asked = "SELECT ?c ?o ?p ?none WHERE { ?c customer:c_name ?name . OPTIONAL { ?o orders:o_custkey ?c } OPTIONAL { ?o orders:o_orderpriority ?p } }"
    out = ask(asked, TableStore(t, {k: MAPPINGS[k] for k in t}))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" in plan and "substring" not in plan[plan.index("inline(") - 200 : plan.index("Cross")]
    alone = [k for k in range(n) if k not in (0, 7)]
    want = [(f"customer/{c}", f"orders/{o}", p, None) for c, o, p in [(0, 1, 'a "b" \\n'), (0, 2, None), (7, 4, "d\te")] + [(c, o, p) for c in alone for o, p in ((1, 'a "b" \\n'), (3, "c"), (4, "d\te"))]]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr) and len(want) > 3 * BLOCK_ROWS
    t["orders"] = t["orders"].where("o_orderkey = 2")
    none = ask(asked, TableStore(t, {k: MAPPINGS[k] for k in t})).collect()
    assert sorted(map(tuple, none), key=repr) == sorted([(f"customer/{c}", "orders/2" if c == 0 else None, None, None) for c in range(n)], key=repr)


def test_only_rows_of_repeated_subjects_are_compared(spark):
    """Triples of lone subjects need no shuffle; repeated and conflicting rows still give a set, null keys too."""
    from quillgraph.operators.graph import Mapping, TableStore

    make = lambda rows: TableStore({"t": spark.createDataFrame(rows, "k long, a string, b double")}, {"t": Mapping(("k",))})
    lone = [(k, f"x{k % 3}", None if k % 4 == 0 else k / 2) for k in range(20)]
    got = make(lone).materialised()
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString() and got.count() == 75
    mixed = make([*lone, lone[3], (5, "other", 2.5), (5, "x2", None), (None, "n", 1.0), (None, "n", 2.0)])
    want = [tuple(r) for r in mixed.triples("t").distinct().collect()]
    got = [tuple(r) for r in mixed.materialised().collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
