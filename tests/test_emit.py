"""Sources made of records parse, and what is extracted from them is what was put in."""

import pytest
from pyspark.sql import functions as F

from quillgraph.operators.compare import macro_scores
from quillgraph.operators.emit import checked, emitted
from quillgraph.operators.extract import features
from quillgraph.operators.recover import extracted

GRAPH = {
    "main.py": '''
from typing import TypedDict
from langchain_openai import ChatOpenAI
from langgraph.graph import StateGraph, START, END
from langgraph.checkpoint.memory import MemorySaver
from tools import search
class State(TypedDict):
    topic: str
    text: list[str]
llm = ChatOpenAI(model="m1")
armed = llm.bind_tools([search])
def plan(state):
    "Plans \\"well\\"."
    out = armed.invoke([SystemMessage(content="Be careful.\\nVery \\\\ so."), HumanMessage(content=f"Plan {state['topic']} {{now}}")])
    return {"text": out.content}
def write(state):
    interrupt("sure?")
    return {"text": llm.invoke([HumanMessage(content="Write it")]).content, "topic": ""}
def clean(state):
    return {"topic": ""}
def pick(state):
    if state["topic"]:
        return "write"
    return "clean"
g = StateGraph(State)
g.add_node("plan", plan)
g.add_node("write", write)
g.add_node("clean", clean)
g.add_edge(START, "plan")
g.add_conditional_edges("plan", pick, {"write": "write", "clean": "clean"})
g.add_edge("write", "clean")
g.add_edge("clean", END)
app = g.compile(checkpointer=MemorySaver())
''',
    "tools.py": '@tool\ndef search(q: str, n: int):\n    "Searches."\n',
}
CHAT = {
    "main.py": '''
from autogen_agentchat.agents import AssistantAgent, UserProxyAgent
client = OpenAIChatCompletionClient(model="m1")
a = AssistantAgent("a", model_client=client, system_message="You help. Be \\"kind\\".", description="d", tools=[look])
b = AssistantAgent("b", model_client=client, system_message="You check.")
u = UserProxyAgent("u")
team = SelectorGroupChat([a, b, u], model_client=client, termination_condition=MaxMessageTermination(5) | TextMentionTermination("STOP"))
async def main():
    await team.run(task="Plan a trip\\nnow")
''',
    "tools.py": 'def look(x: str) -> str:\n    "Looks."\n    return x\n',
}


def sources(spark, systems):
    return spark.createDataFrame([(s, p, t) for s, files in systems.items() for p, t in files.items()], "system_id string, path string, source string")


def again(files):
    return files.select("system_id", "path", F.col("content").alias("source"))


def told(records, kind, *columns):
    return sorted((tuple(r) for r in records[kind].select(*columns).collect()), key=str)


def test_state_graphs_come_back(spark):
    first = extracted(sources(spark, {"one": GRAPH}), "LangGraph")
    files = emitted(first, "LangGraph")
    rows = files.collect()
    assert {r.path for r in rows} == {"main.py", "tools.py"} and all(r.error is None for r in rows)
    second = extracted(again(spark.createDataFrame(rows, files.schema)), "LangGraph")
    for kind, columns in {
        "agents": ("agent_key", "role", "goal", "backstory", "llm", "tools", "human_input"), "tasks": ("task_key", "description", "expected_output", "agent_key"),
        "teams": ("agent_keys", "task_keys", "memory", "coordination_pattern"), "flows": ("class_name", "state_model", "state_fields"),
        "tools": ("tool_key", "description", "args_schema_json"), "flow_steps": ("method_name", "step_type", "function_body", "edge_mapping", "associated_agent_key", "outgoing"),
    }.items():
        assert told(second, kind, *columns) == told(first, kind, *columns), kind
    both = sources(spark, {"ref": GRAPH}).union(spark.createDataFrame([("cand", r.path, r.content) for r in rows], "a string, b string, c string"))
    pairs = spark.createDataFrame([("p", "ref", "cand")], "pair_id string, ref_id string, cand_id string")
    [score] = macro_scores(features(both.withColumnRenamed("system_id", "graph_id")), pairs).collect()
    assert score.overall_f1 > 0.6


def test_group_chats_come_back(spark):
    first = extracted(sources(spark, {"one": CHAT}), "AutoGen_v0.4")
    files = emitted(first, "AutoGen")
    rows = files.collect()
    assert all(r.error is None for r in rows)
    second = extracted(again(spark.createDataFrame(rows, files.schema)), "AutoGen_v0.4")
    assert told(second, "agents", "agent_key", "role", "goal", "backstory", "llm", "tools", "agent_type", "description", "human_input") == told(first, "agents", "agent_key", "role", "goal", "backstory", "llm", "tools", "agent_type", "description", "human_input")
    assert told(second, "tasks", "description", "delegation_strategy") == told(first, "tasks", "description", "delegation_strategy")
    assert told(second, "teams", "agent_keys", "coordination_pattern") == told(first, "teams", "agent_keys", "coordination_pattern")


def test_any_records_make_sources_that_parse(spark):
    """Names that are no identifiers, contexts that point forwards, missing parts, bodies that are no Python."""
    one = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    records = {
        "systems": one("system_id string, name string, framework string, namespace string", ("s", "S", "x", "http://e/"), ("empty", "E", "x", "http://e/")),
        "agents": one("system_id string, agent_key string, role string, goal string, backstory string, tools array<string>, verbose boolean", ("s", "1 bad-key", 'Ro"le\n', None, "x\\", ["t", "ghost"], True), ("s", "class", "", "", None, None, None)),
        "tasks": one("system_id string, task_key string, description string, agent_key string, context_tasks array<string>", ("s", "a", "f'go {x}'", "1 bad-key", ["z"]), ("s", "m", None, "nobody", ["a", "z"]), ("s", "z", 'say "hi"', None, None)),
        "tools": one("system_id string, tool_key string, name string, description string, args_schema_json string", ("s", "t", "my tool", None, '{"properties": {"a b": {"type": "integer"}}}'), ("s", "v", "v", "", "no json")),
        "teams": one("system_id string, team_key string, team_class_name string, agent_keys array<string>, task_keys array<string>, process string", ("s", "team-1", "T", ["class", "gone"], ["m", "a", "z"], "odd")),
        "flows": one("system_id string, class_name string, state_model string, state_fields map<string,string>", ("s", "My Flow", "St ate", {"k 1": "list[int]", "v": "1 +"})),
        "flow_steps": one("system_id string, flow string, ord int, method_name string, step_type string, dependencies array<string>, return_values array<string>, function_body string", ("s", "My Flow", 0, "begin", "start", [], None, None), ("s", "My Flow", 1, "go on", "router", ["begin"], ["x", "y"], "if a:\n    return 'x'"), ("s", "My Flow", 2, "end", "regular", ["x"], None, "")),
    }
    for framework in ("LangGraph", "AutoGen", "CrewAI"):
        rows = emitted(records, framework).collect()
        assert [r.error for r in rows if r.error] == [], framework
        assert {r.system_id for r in rows} == {"s", "empty"}
    crew = next(r.content for r in rows if r.system_id == "s" and r.path == "crew.py")
    assert crew.index("task_z = ") < crew.index("task_a = ") < crew.index("task_m = ") and "context=[task_a, task_z]" in crew
    broken = checked(one("system_id string, path string, content string", ("s", "x.py", "def (")))
    assert "x.py" in broken.first().error
    with pytest.raises(ValueError):
        emitted(records, "Other")
