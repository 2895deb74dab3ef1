from pyspark.sql import functions as F

from quillgraph.operators import extract, report
from quillgraph.operators.lift import lifted
from quillgraph.operators.lower import lowered
from quillgraph.plans.catalog import Vocabulary, run
from quillgraph.sources import trees

CODE = '''
"""A program."""
from x import StateGraph
class State(TypedDict):
    topic: str
@tool
def look(q: str):
    """Looks."""
def plan(state):
    """Plan it."""
def route(state):
    return "write"
g = StateGraph(State)
g.add_node("plan", plan)
g.add_node("write", lambda s: s)
g.add_conditional_edges("plan", route, {"write": "write", "stop": END})
g.set_entry_point("plan")
g.add_edge("write", END)
critic = AssistantAgent(name="critic", system_message="Be strict. Say why.", model="m1")
team = RoundRobinGroupChat([critic], max_turns=4)
'''


def test_programs_become_graphs_and_records_again(spark, tmp_path):
    (tmp_path / "main.py").write_text(CODE)
    (tmp_path / "bad.py").write_text("def (")
    (tmp_path / "__init__.py").write_text("x = 1")
    files = trees.python_files(spark, str(tmp_path)).withColumn("system_id", F.lit("prog")).withColumn("graph_id", F.lit("prog"))
    assert {r.path for r in files.select("path").collect()} == {"main.py", "bad.py"}
    found = extract.program_records(files)
    records = extract.to_records(found, "demo")
    graph = lifted(spark, records, Vocabulary())
    graph.persist()
    assert run(1, graph).count() == 3 and run(24, graph).count() == 1 and run(21, graph).count() == 1
    back = lowered(graph, Vocabulary())
    agents = {r.agent_key: r for r in back["agents"].collect()}
    assert agents["critic"].goal == "Be strict." and agents["critic"].llm == "m1" and agents["plan"].goal == "Plan it."
    steps = {r.method_name: r for r in back["flow_steps"].collect()}
    assert steps["plan"].step_type == "start" and steps["plan"].edge_mapping == {"write": "write", "stop": "END"} and steps["write"].dependencies == ["plan"]
    teams = back["teams"].first()
    assert (teams.max_turns, teams.coordination_pattern, teams.agent_keys) == (4, "RoundRobin", ["critic"])
    again = lifted(spark, back, Vocabulary())
    key = lambda df: {tuple(r) for r in df.select("s", "p", "o").collect()}
    lost = {x for x in key(graph) - key(again) if "hasReference" not in x[1]}
    limit = {x for x in lost if "hasTerminationCondition" in x[1]}  # a limit read back is a numbered condition, by another name
    assert not {x for x in lost - limit if "nextStep" in x[1] or "agentRole" in x[1] or "Team" in x[0]}
    second = lowered(again, Vocabulary())
    for kind in ("agents", "teams", "flow_steps", "flows", "tools"):
        assert sorted(map(repr, second[kind].collect())) == sorted(map(repr, back[kind].collect())), kind
    values = {(r.feature, r.value) for r in extract.features(files).collect()}
    assert ("state_fields", "topic") in values and ("decorators", "@tool") in values
    checked = extract.validity(files).first()
    assert (checked.files_checked, checked.syntax_rate) == (2, 0.5) and len(checked.errors) == 1
    assert extract.pattern_counts(files).where("kind = 'call_method' and key = 'add_node'").first().n == 2
    graph.unpersist()


def test_lifting_rules(spark):
    systems = spark.createDataFrame([("s", "my sys", "F", "http://ex/s")], "system_id string, name string, framework string, namespace string")
    agents = spark.createDataFrame([("s", "a", "R", "G", "B", ["t1", "ext"], True, True, "DualDirective")], "system_id string, agent_key string, role string, goal string, backstory string, tools array<string>, reasoning boolean, memory boolean, directive_function string")
    tools = spark.createDataFrame([("s", "t1", "ToolOne", "One")], "system_id string, tool_key string, class_name string, name string")
    tasks = spark.createDataFrame([("s", "k1", "D", "a", ["FunctionBased:f", "LLMBased:be nice", "plain"], 2, None), ("s", "k2", "E", "nobody", [], None, None), ("s", "k3", "E", "a", [], None, ["later"])], "system_id string, task_key string, description string, agent_key string, guardrails array<string>, guardrail_max_retries int, context_tasks array<string>")
    teams = spark.createDataFrame([("s", "T", ["a", "ghost"], ["k1", "k2", "k3"], "sequential", "boss-model", 5)], "system_id string, team_class_name string, agent_keys array<string>, task_keys array<string>, process string, manager_llm string, max_turns int")
    v = Vocabulary()
    g = lifted(spark, {"systems": systems, "agents": agents, "tools": tools, "tasks": tasks, "teams": teams}, v)
    got = {(r.s, r.p, r.o) for r in g.collect()}
    n = lambda x: f"<http://ex/s#{x}>"
    assert (n("AgentPrompt_a"), v("promptInstruction"), '"R: G"') in got and (n("Tool_ext"), v("hasReference"), '"external:ext"') in got
    assert (n("Agent_a"), v("agentToolUsage"), n("Tool_ToolOne")) in got and (n("Task_k1"), v("performedByAgent"), n("Agent_a")) in got
    assert not any(s == n("Task_k2") and p == v("performedByAgent") for s, p, _ in got)
    assert (n("Task_k2"), v("dependsOn"), n("Task_k1")) in got and (n("Task_k3"), v("dependsOn"), n("Task_later")) in got and (n("Task_k3"), v("dependsOn"), n("Task_k2")) not in got
    assert (n("Guardrail_k1_0"), v("hasValidationLogic"), '"f"') in got and (n("Guardrail_k1_2"), v("hasDescription"), '"plain"') in got
    assert (n("Agent_manager_T"), v("agentRole"), '"Manager"') in got and (n("my_sys"), v("containsAgent"), n("Agent_manager_T")) in got
    assert not any(o == n("Agent_ghost") for _, _, o in got) and (n("TurnLimit_T"), v("hasMaxTurns"), '"5"^^<http://www.w3.org/2001/XMLSchema#integer>') in got
    assert (n("CrewStep_T_k1"), v("nextStep"), n("CrewStep_T_k2")) in got


def test_responses_and_reports(spark, tmp_path):
    said = "--- ../a/b.py ---\n```python\nx = 1\n```\n--- /c.py ---\n```\ny\n```"
    rows = {(r.id, r.path): r.content for r in trees.response_files(spark.createDataFrame([(1, said), (2, "no files")], "id int, text string")).collect()}
    assert rows == {(1, "a/b.py"): "x = 1\n", (1, "c.py"): "y\n", (2, "raw_output.txt"): "no files"}
    trees.write_files(spark.createDataFrame([("../o/f.txt", "hi")], "path string, content string"), str(tmp_path))
    assert (tmp_path / "o" / "f.txt").read_text() == "hi"
    runs = spark.createDataFrame([("r1", "p", "e1", ["x", "y"]), ("r2", "p", "e2", [])], "run_id string, pipeline string, example string, errors array<string>")
    metric = spark.createDataFrame([("r1", 0.5)], "run_id string, f1 double")
    flat = report.flattened(runs, {"pair": metric})
    assert flat.columns == ["run_id", "pipeline", "example", "pair_f1", "errors"]
    lines = [r.line for r in report.markdown(flat, ["example"]).collect()]
    assert lines[0] == "| pipeline | example | pair_f1 | errors |" and lines[2] == "| p | e1 | 0.500 | x | y |" and "| — |" in lines[3]
    assert report.clean_runs(flat).first().clean == 1
    (tmp_path / "n.ipynb").write_text('{"cells": [{"cell_type": "code", "source": ["%magic\\n", "a = 1"]}, {"cell_type": "markdown", "source": ["t"]}, {"cell_type": "code", "source": ["b = 2"]}]}')
    assert trees.notebooks(spark, str(tmp_path), drop_magics=True).first().source == "a = 1\n\nb = 2"
    (tmp_path / "agents.yaml").write_text("writer:\n  role: Writer\n  n: 3\n")
    y = trees.yaml_entries(spark, str(tmp_path)).first()
    assert y.key == "writer" and y.fields == {"role": "Writer", "n": "3"}


GROUPS = '''
one = AssistantAgent(name="first writer")
two = AssistantAgent(name="second writer")
a = RoundRobinGroupChat([one], max_turns=2)
b = RoundRobinGroupChat([one, two], max_turns=3)
x = Task(description="Write a long report about the state of things: north", agent=one)
y = Task(description="Write a long report about the state of things: south", agent=two)
tasks = [Task(description="Sum up"), Task(description="Sum up")]
def side():
    one = AssistantAgent(name="third writer")
    return Swarm([one, Agent(role="inline")])
'''

CREW = '''
from util import helper
class NewsCrew:
    @agent
    def reader(self):
        return Agent(config=self.agents_config["reader"])
    @agent
    def editor(self):
        made = Agent(config=self.agents_config["editor"])
        return made
    @task
    def read(self):
        return Task(config=self.tasks_config["read"], agent=self.reader())
    @task
    def edit(self):
        return Task(config=self.tasks_config["edit"], agent=self.editor())
    @crew
    def crew(self):
        return Crew(agents=self.agents, tasks=self.tasks)
loose = Crew(agents=[helper])
'''


def test_every_agent_task_and_team_is_kept(spark):
    util, other = 'helper = Agent(role="Helper")\n', 'helper = Agent(role="Helper")\nteam = RoundRobinGroupChat([helper])\n'
    rows = [("g", "a.py", GROUPS), ("c", "crew.py", CREW), ("c", "util.py", util), ("c", "z.py", other)]
    found = extract.program_records(spark.createDataFrame(rows, "system_id string, path string, source string").repartition(3))
    r = {k: v.collect() for k, v in extract.to_records(found, "demo").items() if k in ("agents", "tasks", "teams")}
    agents, tasks, teams = ([x for x in r[k] if x.system_id == "g"] for k in ("agents", "tasks", "teams"))
    assert {x.agent_key for x in agents} == {"first writer", "second writer", "third writer", "inline"}
    assert len({x.team_key for x in teams}) == 3
    assert {(x.team_class_name, x.max_turns, tuple(x.agent_keys)) for x in teams} == {("RoundRobinGroupChat", 2, ("first writer",)), ("RoundRobinGroupChat", 3, ("first writer", "second writer")), ("Swarm", None, ("third writer", "inline"))}
    assert {(x.task_key, x.description[-5:], x.agent_key) for x in tasks if x.agent_key} == {("x", "north", "first writer"), ("y", "south", "second writer")}
    assert len({x.task_key for x in tasks if x.description == "Sum up"}) == 2
    agents, tasks, teams = ([x for x in r[k] if x.system_id == "c"] for k in ("agents", "tasks", "teams"))
    assert {x.agent_key for x in agents if not x.agent_key.startswith("Helper")} == {"reader", "editor"} and len({x.agent_key for x in agents}) == 4
    assert {(x.task_key, x.agent_key) for x in tasks} == {("read", "reader"), ("edit", "editor")}
    members = {x.team_key: x.agent_keys for x in teams}
    assert members["NewsCrew"] == ["reader", "editor"] and len(members) == 3
    assert members["Crew"] != members["RoundRobinGroupChat"] and {*members["Crew"], *members["RoundRobinGroupChat"]} == {x.agent_key for x in agents if x.role == "Helper"}


def test_features_and_patterns_by_definition(spark):
    code = """
import os.path, json
from typing import Annotated
from pydantic import BaseModel
from . import near
class S(BaseModel, mixin.Other[int]):
    a: Annotated[list, add] = []
    b: int
class Plain:
    c: int = 1
@tool
@listen("x")
@router(or_(one, two))
def f(self, x: int, y, z: list[int]): pass
g.add_node("n", f)
g.add_edge(START, "n")
run(START)
"""
    files = spark.createDataFrame([("g", "m.py", code), ("g", "bad.py", "def (")], "graph_id string, path string, source string")
    got = {}
    for r in extract.features(files).collect():
        got.setdefault(r.feature, set()).add(r.value)
    assert got == {
        "imports": {"os", "json", "typing", "pydantic"}, "classes": {"S", "Plain"}, "class_bases": {"?,BaseModel", ""}, "functions": {"f"},
        "decorators": {"@tool", '@listen("x")', "@router(?)"}, "state_fields": {"a", "b"}, "state_annotations": {"a: Annotated[list, add]", "b: int"},
        "graph_calls": {"g.add_node(n)", "g.add_edge(START)"},
    }
    counts = extract.pattern_counts(files)
    rules = spark.createDataFrame([("r1", "class_base", "BaseModel"), ("r2", "class_base", "Other"), ("r3", "any_decorator", "tool,start"), ("r4", "decorator", "listen"), ("r5", "decorator_arg", "listen"), ("r6", "decorator_call_name", "router(or_)"), ("r7", "reducer_field", ""), ("r8", "pydantic_default", ""), ("r9", "call_method", "run(START)"), ("r10", "call_with_const", "add_node"), ("r11", "call_method", "gone")], "rule string, kind string, key string")
    assert {r.rule: r.n for r in extract.rule_counts(counts, rules).collect()} == {f"r{k}": 1 for k in range(1, 11)}
    import ast

    f = next(n for n in ast.walk(ast.parse(code)) if isinstance(n, ast.FunctionDef))
    assert extract.signature_schema(f) == {"type": "object", "properties": {"x": {"type": "integer"}, "y": {"type": "string"}, "z": {"type": "string"}}, "required": ["x", "y", "z"]}
    assert extract.fields_schema({"b": "Optional[int]", "a": {"type": "float", "description": "d"}}) == '{"properties":{"a":{"description":"d","type":"number"},"b":{"nullable":true,"type":"integer"}},"required":["a"],"type":"object"}'


def test_listings_bundles_and_notebooks(spark, tmp_path):
    import json

    (tmp_path / "one/source_files").mkdir(parents=True)
    (tmp_path / "two").mkdir()
    for name, text in (("one/source_files/a.py", "x = 1"), ("one/set.cfg", "k=v"), ("two/b.py", "y"), ("two/c.bin", "no")):
        (tmp_path / name).write_text(text)
    cells = [{"cell_type": "code", "source": "a = 1\n!ls\nb"}, {"cell_type": "markdown", "source": ["t"]}, {"cell_type": "code", "source": ["c\n", "%m\n", "d"]}, {"cell_type": "code", "source": "[1, 2]"}]
    (tmp_path / "two/n.ipynb").write_text(json.dumps({"cells": cells}))
    assert trees.notebooks(spark, str(tmp_path)).first().source == "a = 1\n!ls\nb\n\nc\n%m\nd\n\n[1, 2]"
    assert trees.notebooks(spark, str(tmp_path), drop_magics=True).first().source == "a = 1\nb\n\nc\nd\n\n[1, 2]"
    assert {r.group: r.text for r in trees.bundle(spark, str(tmp_path)).collect()} == {"one": "--- one/set.cfg ---\nk=v\n\n--- one/source_files/a.py ---\nx = 1", "two": "--- two/b.py ---\ny"}
    assert {r.group: r.text for r in trees.skeleton(spark, str(tmp_path)).collect()}["two"] == "--- two/b.py ---\n```python\ny\n```"
    listing = spark.createDataFrame([("one/source_files/a.py",), ("two/b.py",), ("x.ttl",), ("f/two/extracted.ttl",)], "path string")
    assert {r.example: r.root for r in trees.source_root(listing).collect()} == {"one": "one/source_files", "two": "two", "f": "f"}
    assert [r.name for r in trees.fixtures(listing).collect()] == ["x"] and trees.extractions(listing).first().framework == "f"


def test_links_states_and_texts_survive(spark):
    from quillgraph.operators import compare, lower

    v = Vocabulary()
    systems = spark.createDataFrame([("s", "my sys", "LangGraph", "http://ex/s")], "system_id string, name string, framework string, namespace string")
    flows = spark.createDataFrame([("s", "F", {'say "hi"': "a\\\\b"})], "system_id string, class_name string, state_fields map<string,string>")
    agents = spark.createDataFrame([("s", "a", ["t"]), ("s", "b", ["t", "u"])], "system_id string, agent_key string, tools array<string>")
    g = lifted(spark, {"systems": systems, "flows": flows, "agents": agents}, v)
    assert lowered(g, v)["flows"].first().state_fields == {'say "hi"': "a\\\\b"}
    links = spark.createDataFrame([("s", "agent_tool", "A", "t"), ("s", "agent_tool", "b", "gone")], "graph_id string, kind string, a string, b string")
    got = {r.kind: r for r in compare.relation_recall(links, g, spark.createDataFrame([("s",)], "graph_id string"), v).collect()}
    assert (got["agent_tool"].source_count, got["agent_tool"].graph_count, got["agent_tool"].recall) == (2, 3, 0.5) and got["team_member"].recall == 1.0
    tasks = spark.createDataFrame([("s", "k", "out"), ("s", "l", "")], "system_id string, task_key string, expected_output string")
    bare = spark.createDataFrame([("s", "F", {})], "system_id string, class_name string, state_fields map<string,string>")
    assert lower.with_state(systems, bare, tasks).first().state_fields == {"k_output": "str"}
    assert lower.with_state(systems, bare, tasks.limit(0)).first().state_fields == {"shared_context": "str"}
    models = spark.createDataFrame([("s", "M", '{"properties": {"a": {"type": "int"}, "b": {}}}')], "system_id string, class_name string, schema_json string")
    assert lower.fields_of(models).first().fields == {"a": "int", "b": "str"}
    assert extract.without_model(spark.createDataFrame([("s", "a", "R", "")], "system_id string, agent_key string, role string, llm string")).count() == 1


NEWS = """
from crewai import Agent, Crew, LLM, Process, Task
class Report(BaseModel):
    title: str = Field(description="Its title")
    pages: Optional[int]
class State(Report):
    topic: str
@CrewBase
class News:
    agents_config = "config/agents.yaml"
    tasks_config = "config/tasks.yaml"
    llm = LLM(model="m-large")
    @agent
    def reader(self):
        return Agent(config=self.agents_config["reader"], verbose=True, tools=[look])
    @task
    def read(self):
        return Task(config=self.tasks_config["read"], human_input=True)
    @task
    def write(self):
        return Task(config=self.tasks_config["write"], context=[self.read()], output_pydantic=Report, guardrail=check)
    @crew
    def crew(self):
        return Crew(agents=self.agents, tasks=self.tasks, process=Process.hierarchical, memory=True)
class Main(Flow[State]):
    @start()
    def begin(self):
        News().crew().kickoff()
    @router(begin)
    def choose(self):
        return "good" if self.ok else "bad"
    @listen(or_("good", choose))
    def finish(self): pass
"""
CHAT = """
stop = TextMentionTermination("DONE")
most = MaxMessageTermination(max_messages=7)
team = SelectorGroupChat([a], termination_condition=stop | most)
g.add_node("hop", hop)
g.add_node("leap", leap)
def hop(s): return Command(goto="leap")
def leap(s):
    if s: return Command(goto="hop")
    return Command(goto=END)
"""


def test_configured_crews_flows_and_endings(spark, tmp_path):
    (tmp_path / "crews/news/config").mkdir(parents=True)
    (tmp_path / "crews/news/news.py").write_text(NEWS)
    (tmp_path / "chat.py").write_text(CHAT)
    (tmp_path / "crews/news/config/agents.yaml").write_text("reader:\n  role: >\n    Chief Reader\n  goal: Read all\n  backstory: Old\n")
    (tmp_path / "crews/news/config/tasks.yaml").write_text("read:\n  description: Read it\n  expected_output: Notes\n  agent: reader\nwrite:\n  description: Write it\n  agent: reader\n")
    files = trees.python_files(spark, str(tmp_path)).withColumn("system_id", F.lit("n"))
    entries = trees.yaml_entries(spark, str(tmp_path)).withColumn("system_id", F.lit("n"))
    r = extract.to_records(extract.program_records(files, strict=True), "CrewAI", entries=entries)
    a = r["agents"].where("agent_key = 'reader'").first()
    assert (a.role, a.goal, a.backstory, a.llm, a.tools, a.verbose) == ("Chief Reader", "Read all", "Old", "m-large", ["look"], True)
    tasks = {x.task_key: x for x in r["tasks"].collect()}
    assert (tasks["read"].description, tasks["read"].expected_output, tasks["read"].agent_key, tasks["read"].human_input) == ("Read it", "Notes", "reader", True)
    assert (tasks["write"].context_tasks, tasks["write"].output_pydantic, tasks["write"].guardrails) == (["read"], "Report", ["FunctionBased:check"])
    teams = {x.team_key: x for x in r["teams"].collect()}
    assert (teams["News"].agent_keys, teams["News"].task_keys, teams["News"].process, teams["News"].memory) == (["reader"], ["read", "write"], "hierarchical", True)
    end = teams["SelectorGroupChat"].termination_conditions[0]
    assert (end.type, end.operator, [(c.type, c.trigger, c.max_turns) for c in end.conditions]) == ("Composite", "OR", [("EventBased", "DONE", None), ("TurnLimit", None, 7)])
    flow = r["flows"].where("class_name = 'Main'").first()
    assert (flow.state_model, flow.state_fields, flow.crew_references) == ("State", {"topic": "str"}, ["News"])
    steps = {x.method_name: x for x in r["flow_steps"].collect()}
    assert (steps["begin"].step_type, steps["begin"].calls_crew) == ("start", "News")
    assert (steps["choose"].step_type, steps["choose"].dependencies, steps["choose"].return_values) == ("conditional", ["begin"], ["good", "bad"]) and "self.ok" in steps["choose"].function_body
    assert (steps["finish"].dependencies, steps["finish"].aggregation_combinator) == (["good", "choose"], "or_")
    assert steps["hop"].outgoing == ["leap"] and steps["leap"].edge_mapping == {"hop": "hop", "END": "END"}
    assert r["models"].where("class_name = 'Report'").first().schema_json == '{"properties":{"pages":{"nullable":true,"type":"integer"},"title":{"description":"Its title","type":"string"}},"required":["title"],"type":"object"}'
    g = lifted(spark, r, Vocabulary())
    back = lowered(g, Vocabulary())
    assert back["teams"].where("team_key = 'News'").first().process == "hierarchical"
    (tmp_path / "broken.py").write_text("def (")
    broken = trees.python_files(spark, str(tmp_path)).withColumn("system_id", F.lit("n"))
    import pytest

    with pytest.raises(Exception, match="broken.py"):
        extract.program_records(broken, strict=True).collect()
