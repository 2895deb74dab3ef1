"""What is told by several files together: names, texts, models, tools, memories, tasks out of run calls."""

import ast

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.operators.lift import lifted
from quillgraph.operators.recover import Recovery, extracted
from quillgraph.operators.said import Scope, parts, rendered
from quillgraph.operators.symbols import Symbols, facts

TEXT = st.text(st.characters(codec="utf-8", exclude_categories=("Cs",), exclude_characters="\x00"), max_size=12)


@st.composite
def expressions(draw, depth=3):
    """Source of a closed string expression."""
    kind = draw(st.integers(0, 7)) if depth else 0
    inner = lambda: draw(expressions(depth - 1))
    if kind <= 1:
        return repr(draw(TEXT))
    if kind == 2:
        return f"({inner()} + {inner()})"
    if kind == 3:
        return f"{draw(TEXT)!r}.join([{inner()}, {inner()}])"
    if kind == 4:
        return f"({draw(TEXT).replace('%', '%%')!r} + '%s!%s' % ({inner()}, {inner()}))"
    if kind == 5:
        return f"'a {{}} b {{x}}'.format({inner()}, x={inner()})"
    if kind == 6:
        return f"f'p {{{inner()}}} q'"
    return f"({inner()}).strip()"


@settings(max_examples=150, deadline=None)
@given(expressions())
def test_closed_texts_are_what_python_says(source):
    try:
        node = ast.parse(source, mode="eval").body
    except SyntaxError:  # an inner text that an older f-string cannot hold
        return
    said = parts(node, Scope())
    whole = all(p[0] == "t" for p in said)
    if whole and ".strip()" not in source:
        assert rendered(said) == eval(compile(ast.Expression(node), "", "eval"))  # a closed expression of this test's own making


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(TEXT.map(lambda t: ["t", t]), st.sampled_from(["x", "y['k']", 'z["k"]', "f(x, 'a')", "'b'.join(x)"]).map(lambda h: ["h", h, -1, ""])), max_size=6))
def test_rendered_texts_are_python_again(pieces):
    text = rendered(pieces)
    holes = [p[1] for p in pieces if p[0] == "h"]
    if holes and len([p for p in pieces if p[0] == "h" or p[1]]) > 1:
        back = parts(ast.parse(text, mode="eval").body, Scope())
        joined = "".join(p[1] for p in pieces if p[0] == "t")
        assert "".join(p[1] for p in back if p[0] == "t") == joined
        assert [p[2] if p[0] == "n" else p[1] for p in back if p[0] != "t"] == [ast.unparse(ast.parse(h, mode="eval").body) for h in holes]


def test_holes_keep_names_and_formats():
    said = lambda s: rendered(parts(ast.parse(s, mode="eval").body, Scope()))
    assert said("f'a {x!r:>9} {state[\"k\"]}\\n'") == "f'a {x!r:>9} {state['k']}\\n'" or said("f'a {x!r:>9} {state[\"k\"]}\\n'") == "f\"a {x!r:>9} {state['k']}\\n\""
    assert said("'a %s b %(z)d %%' % (x,)") == "f'a {x} b {z} %'"
    assert said("'{who} {0} {{}}'.format(n, who='Bob')") == "f'Bob {n} {{}}'"
    assert parts(ast.parse("1 + 2", mode="eval").body, Scope()) is None and parts(ast.parse("g(x)", mode="eval").body, Scope()) is None


MODELS = """
from langchain_openai import ChatOpenAI
from .names import MODEL as CHOSEN
llm = ChatOpenAI(model=CHOSEN)
fast = ChatOpenAI(model="small")
def make_model(): return ChatOpenAI(model="made-" + "here")
"""
NODES = """
from shared.models import llm, fast
import shared.prompts as p
from shared import make_model
from tools import search, add as plus
from langgraph.types import interrupt, Command
from langgraph.prebuilt import ToolNode, create_react_agent
kit = [search, plus]
armed = llm.bind_tools(kit)
chain = p.TEMPLATE | armed
helper = create_react_agent(fast, tools=[plus], prompt=p.LONG)
maker = make_model()

def plan(state):
    "Plans."
    system = SystemMessage(content=p.LONG)
    out = chain.invoke([system, HumanMessage(content=f"Plan {state['topic']} as {p.STYLE}")])
    return {"plan": out, "log": 1}

def write(state):
    task = "Write " + p.STYLE
    text = maker.invoke([{"role": "system", "content": "You write"}, HumanMessage(content=task)])
    interrupt("ok?")
    return {"text": text}

def calc(state):
    return helper.invoke(state)

def reset(state):
    return {"plan": None}

def ask(state):
    question = state["q"]
    return llm.invoke([HumanMessage(content=question)])

def guarded(tools): return ToolNode(tools).with_fallbacks([])
def enter(name):
    def entry(state): return {"at": name}
    return entry
def make_boss(llm):
    def boss(state): return Command(goto=llm.invoke(state))
    return boss
boss_node = make_boss(llm)
def route(state):
    "Where to."
    if state["x"]:
        return "write"
    return END
"""
MAIN = """
from nodes import *
import nodes
from langgraph.graph import StateGraph, START, END
from state import Wide
from langgraph.checkpoint.memory import MemorySaver
saver = MemorySaver()
graph = StateGraph(Wide)
graph.add_node("plan", plan)
graph.add_node("write", nodes.write)
graph.add_node("calc", calc)
graph.add_node(reset)
graph.add_node("ask", ask)
graph.add_node("tools", guarded(kit))
graph.add_node("enter_x", enter("x"))
graph.add_node("boss", boss_node)
graph.add_node("unknown", somewhere_else)
graph.add_edge(START, "plan")
graph.add_edge("write", "__end__")
graph.add_conditional_edges("plan", route)
app = graph.compile(checkpointer=saver, store=Disk(), interrupt_before=["calc"])
"""
SYSTEM = {
    "shared/__init__.py": "from .models import make_model\n",
    "shared/models.py": MODELS,
    "shared/names.py": "from .deep import NAME\nMODEL = NAME\n",
    "shared/deep.py": "NAME = 'big' + '-1'\n",
    "shared/prompts.py": "from langchain_core.prompts import ChatPromptTemplate\nSTYLE = 'short {text}'\nLONG = '''You are\n  careful.''' + ' Be ' + STYLE\nTEMPLATE = ChatPromptTemplate.from_messages([('system', LONG)])\n",
    "tools.py": "@tool\ndef search(q: str, k: int): 'Searches.'\ndef add(a: int, b: float): 'Adds.'\n",
    "state.py": "from base import Narrow\nclass Wide(Narrow):\n    text: str\n",
    "base.py": "from typing import TypedDict\nclass Narrow(TypedDict):\n    topic: str\n    text: int\nclass Plain: pass\n",
    "nodes.py": NODES, "main.py": MAIN, "broken.py": "def (",
}


def sources(spark, systems):
    rows = [(s, path, text) for s, files in systems.items() for path, text in files.items()]
    return spark.createDataFrame(rows, "system_id string, path string, source string").repartition(3)


def test_state_graphs_across_files(spark):
    records = extracted(sources(spark, {"one": SYSTEM, "two": {"a.py": "x = 1\n"}, "none": {"b.py": ""}}), "LangGraph")
    agents = {r.agent_key: r for r in records["agents"].collect()}
    assert set(agents) == {"plan", "write", "calc", "ask", "boss", "unknown"}  # not: tool nodes, handlers, resets
    long = "You are\n  careful. Be short {text}"
    assert (agents["plan"].llm, agents["plan"].tools, agents["plan"].backstory, agents["plan"].goal) == ("big-1", ["add", "search"], long, "Plans.")
    assert (agents["write"].llm, agents["write"].backstory, agents["write"].human_input) == ("made-here", "You write", True)
    calc = agents["calc"]
    assert (calc.llm, calc.tools, calc.backstory, calc.reasoning, calc.reasoning_pattern, calc.human_input) == ("small", ["add"], long, True, "ReAct", True)
    assert (agents["ask"].llm, agents["ask"].human_input, agents["unknown"].llm) == ("big-1", False, None)
    tasks = {r.task_key: (r.description, r.expected_output) for r in records["tasks"].collect()}
    assert tasks["task_plan"][1] == "plan,log" and "short {{text}}" in tasks["task_plan"][0] and "{state['topic']}" in tasks["task_plan"][0]
    assert tasks["task_write"] == ("Write short {text}", "text")
    assert tasks["task_ask"][0] == "f\"{state['q']}\"" or tasks["task_ask"][0].startswith(("Perform ask", "state"))
    [team] = records["teams"].collect()
    assert team.agent_keys == ["plan", "write", "calc", "ask", "boss", "unknown"] and team.memory and team.coordination_pattern == "Hierarchical"
    steps = {r.method_name: r for r in records["flow_steps"].collect()}
    assert "return 'write'" in steps["plan"].function_body and steps["plan"].associated_agent_key == "plan" and steps["tools"].associated_agent_key is None
    [flow] = [r for r in records["flows"].collect()]
    assert (flow.state_model, flow.state_fields) == ("Wide", {"topic": "str", "text": "str"})
    schema = {r.tool_key: r.args_schema_json for r in records["tools"].collect()}
    assert '"k": {"type": "integer"}' in schema["search"]
    triples = {(r.s.rpartition("#")[2].rstrip(">"), r.p.rpartition("#")[2].rpartition("/")[2].rstrip(">")) for r in lifted(spark, records).collect()}
    assert ("Team_langgraph_team_0", "hasTeamMemoryBinding") in triples and {("Agent_calc", "hasHumanCheckpoint"), ("Agent_write", "hasHumanCheckpoint")} <= triples


def test_memories_and_classes(spark):
    recovery = Recovery(facts(sources(spark, {"one": SYSTEM})))
    assert [(r.type, r.persistence) for r in recovery.memories().collect()] == [("Disk", "Persistent")]
    models = {r.class_name for r in recovery.models_across_files().collect()}
    assert models == {"Wide", "Narrow"}
    with pytest.raises(Exception, match="broken.py"):
        facts(sources(spark, {"one": SYSTEM}), strict=True).collect()


CHAT = """
import asyncio
from clients import client
from autogen_agentchat.agents import AssistantAgent, UserProxyAgent
from funcs import lookup, count
from store import notes
wrapped = FunctionTool(lookup, description="Looks " + "up")
helper = AssistantAgent("helper", model_client=client, tools=[wrapped, count], memory=[notes, ListMemory()], system_message="You help. Always.", description="d")
old = AssistantAgent(name="old", llm_config={"config_list": [{"model": "gpt-x"}]}, human_input_mode="ALWAYS")
person = UserProxyAgent("person")
team = RoundRobinGroupChat([helper, old], max_turns=3)
other = RoundRobinGroupChat([helper])
WHAT = "Plan a trip"

async def go(what):
    await Console(team.run_stream(task=what))

async def main():
    await team.run(task="Say " + WHAT)
    await go(WHAT)
    person.initiate_chat(helper, message="Hi there")
    await other.run(task=unknown)
    asyncio.run(go("x"))
"""


def test_group_chats_across_files(spark):
    files = {"main.py": CHAT, "clients.py": "from autogen_ext.models.openai import OpenAIChatCompletionClient as C\nfrom autogen_ext.models.openai import OpenAIChatCompletionClient\nclient = OpenAIChatCompletionClient(model='o3-mini')\n", "funcs.py": "def lookup(q: str) -> str:\n    'doc'\ndef count(n: int): 'Counts.'\ndef _hidden(): pass\nclass K:\n    def method(self): pass\n", "store.py": "notes = ChromaDBVectorMemory()\n"}
    records = extracted(sources(spark, {"one": files}), "AutoGen_v0.4")
    agents = {r.role: r for r in records["agents"].collect()}
    h = agents["helper"]
    assert (h.llm, h.reasoning, h.reasoning_origin, h.tools, h.memory, h.memory_type, h.memory_persistence) == ("o3-mini", True, "ModelNative", ["lookup", "count"], True, "ChromaDBVectorMemory", "Persistent")
    assert (h.goal, h.backstory, h.prompt_source) == ("You help.", "Always.", "system_message, description")
    assert (agents["old"].llm, agents["old"].human_input, agents["person"].human_input, agents["person"].agent_type) == ("gpt-x", True, True, "UserProxy")
    tools = {r.tool_key: r for r in records["tools"].collect()}
    assert set(tools) == {"lookup", "count", "go"} and (tools["lookup"].description, tools["count"].description, tools["lookup"].implementation_ref) == ("Looks up", "Counts.", "funcs.lookup")
    assert sorted(r.description for r in records["tasks"].collect()) == ["Hi there", "Plan a trip", "Say Plan a trip", "x"]
    steps = {r.method_name: r.calls_crew for r in records["flow_steps"].collect()}
    assert steps == {"run_team": "team", "initiate_chat_person_to_helper": "helper", "run_other": "other"}
    assert sorted(r.team_key for r in records["teams"].collect()) == ["RoundRobinGroupChat_0", "RoundRobinGroupChat_1"]


def test_names_through_many_files(spark):
    """A constant handed on through 60 files, a ring of imports, and two systems with files of one name."""
    chain = {f"m{k}.py": f"from m{k - 1} import VALUE\n" for k in range(1, 60)} | {"m0.py": "VALUE = 'deep'\n", "use.py": "from m59 import VALUE as V\nOUT = V + '!'\n"}
    ring = {"a.py": "from b import X\n", "b.py": "from a import X\nY = X + '?'\n", "m0.py": "VALUE = 'other'\n", "use.py": "from m0 import VALUE as V\nOUT = V + '!'\n"}
    s = Symbols(facts(sources(spark, {"chain": chain, "ring": ring})))
    wanted = spark.createDataFrame([("chain", "1", "use.py", [["n", "OUT", "OUT"]]), ("ring", "1", "use.py", [["n", "OUT", "OUT"]]), ("ring", "2", "b.py", [["n", "Y", "Y"]])], "system_id string, id string, path string, said array<array<string>>")
    assert {(r.system_id, r.id): r.text for r in s.texts(wanted).collect()} == {("chain", "1"): "deep!", ("ring", "1"): "other!", ("ring", "2"): "f'{X}?'"}
