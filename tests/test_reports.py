"""Reports of runs as Markdown, and rules out of files."""

from quillgraph.operators.extract import pattern_counts, rule_counts, rules_of
from quillgraph.operators.report import run_reports


def test_a_report_a_run(spark):
    runs = spark.createDataFrame([(1, "extraction", "A", "e1", "src", "out", "A"), (2, "roundtrip", "A", None, None, "out", "B")], "run_id long, pipeline string, framework string, example string, source_dir string, work_dir string, target_framework string")
    steps = spark.createDataFrame([(1, 1, "score", False, None, "boom"), (1, 0, "extract", True, "g.ttl", None)], "run_id long, ord int, step string, ok boolean, output string, error string")
    metrics = spark.createDataFrame([(1, 0, "f1", {"triples": "0.900", "links": None})], "run_id long, ord int, name string, values map<string,string>")
    got = {r.run_id: r.text for r in run_reports(runs, steps, metrics).collect()}
    assert got[1] == "# Extraction — A/e1\n\n- source: `src`\n- work dir: `out`\n\n## Pipeline\n- `extract` ✓ g.ttl\n- `score` ✗ boom\n\n## f1\n- links: —\n- triples: 0.900\n\n"
    assert got[2] == "# Roundtrip — A/?\n\n- source: `?`\n- target framework: `B`\n- work dir: `out`\n\n"
    assert run_reports(runs.limit(0), steps, metrics).count() == 0


def test_rules_from_files(spark):
    text = """
rules:
  - id: nodes   # counted once a call
    left: {call_method: add_node}
    right: {any_decorator: [listen, start], class_base: [Flow, Crew]}
  - name: empty
  - left: {call_method: lost}
"""
    rules = rules_of(spark.createDataFrame([(text,), ("",), (None,)], "text string"))
    assert sorted(map(tuple, rules.collect())) == [("nodes", "left", "call_method", "add_node"), ("nodes", "right", "any_decorator", "listen,start"), ("nodes", "right", "class_base", "Crew"), ("nodes", "right", "class_base", "Flow")]
    files = spark.createDataFrame([("g", "a.py", "g.add_node('x')\ng.add_node(y)\nclass A(Flow):\n    @listen('x')\n    def f(self): pass\n")], "graph_id string, path string, source string")
    counts = pattern_counts(files)
    sides = {s: {r.rule: r.n for r in rule_counts(counts, rules.where(f"side = '{s}'")).collect()} for s in ("left", "right")}
    assert sides == {"left": {"nodes": 2}, "right": {"nodes": 2}}
