"""Records to Python sources: programs of three frameworks, checked to parse.

Every record is written by Spark functions as a piece of text with a section and an order; the pieces of a
file are put together by a sort within it. What refers to something stands behind it: tasks are ordered by
how many tasks they build on, so any order that contexts allow is kept.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .closure import checkpointed, transitive
from .extract import python_text
from .records import CONDITION, SCHEMAS
from .workflow import resolved_edges

#: Types of JSON Schema as Python annotations.
ANNOTATIONS = {"string": "str", "integer": "int", "number": "float", "boolean": "bool", "array": "list", "object": "dict"}
FRAMEWORKS = ("LangGraph", "AutoGen", "CrewAI")


def ident(c: Column | str) -> Column:
    """A name as a Python identifier."""
    c = F.col(c) if isinstance(c, str) else c
    plain = F.regexp_replace(c, r"[^A-Za-z0-9_]", "_")
    return F.when(plain.rlike("^[0-9]") | (plain == "") | plain.isin("None", "True", "False", "class", "def", "from", "import", "return", "lambda", "pass", "in", "is", "if", "for"), F.concat(F.lit("_"), plain)).otherwise(plain)


def quoted(c: Column | str) -> Column:
    """A text as a Python literal; the source of an f-string stays as it is."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.when(c.rlike(r"""(?s)^f(["']).*\1$"""), c).otherwise(F.concat(F.lit('"'), python_text(c), F.lit('"')))


def plain(c: Column | str) -> Column:
    """A text as a Python literal, whatever it looks like."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.concat(F.lit('"'), python_text(c), F.lit('"'))


def names(c: Column | str) -> Column:
    """[a, b] of the names in an array."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast("array<string>"))
    return F.concat(F.lit("["), F.array_join(F.transform(c, ident), ", "), F.lit("]"))


def said(*parts: Column | str) -> Column:
    """Parts put together; texts stand for themselves."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])


def when(test: Column, *parts: Column | str) -> Column:
    return F.when(test, said(*parts)).otherwise(F.lit(""))


def filled(c: str) -> Column:
    return F.coalesce(F.col(c) != "", F.lit(False))


class Emitter:
    def __init__(self, records: dict[str, DataFrame]):
        spark = records["systems"].sparkSession
        self.r = {}
        for kind, schema in SCHEMAS.items():
            want = spark.createDataFrame([], schema)
            rows = records.get(kind, want)
            self.r[kind] = checkpointed(rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in want.dtypes]))
        self.pieces: list[DataFrame] = []

    def put(self, rows: DataFrame, path: str, section: int, text: Column, order: Column | None = None) -> None:
        at = F.lit("") if order is None else order.cast("string")
        self.pieces.append(rows.select("system_id", F.lit(path).alias("path"), F.lit(section).alias("section"), at.alias("at"), text.alias("text")).where("text <> ''"))

    def tools(self, decorated: bool) -> None:
        t = self.r["tools"]
        fields = F.from_json("args_schema_json", "properties map<string, struct<type: string>>, required array<string>")
        types = F.create_map(*[F.lit(x) for kv in ANNOTATIONS.items() for x in kv])
        known = F.coalesce(fields["properties"], F.from_json(F.lit("{}"), "map<string, struct<type: string>>"))
        # the required ones stand in the order of the signature
        required = F.filter(F.coalesce(fields["required"], F.array().cast("array<string>")), lambda n: F.map_contains_key(known, n))
        kind = lambda n: F.coalesce(F.try_element_at(types, F.try_element_at(known, n)["type"]), F.lit("str"))
        arguments = F.array_join(F.transform(F.array_union(required, F.array_sort(F.map_keys(known))), lambda n: F.concat(ident(n), F.lit(": "), kind(n))), ", ")
        self.put(t.select("system_id").distinct(), "tools.py", 0, F.lit("from langchain_core.tools import tool\n\n" if decorated else "\n"))
        self.put(t, "tools.py", 1, said("@tool\n" if decorated else "", "def ", ident("name"), "(", arguments, "):\n    ", plain("description"), '\n    return ""\n\n\n'), F.col("tool_key"))

    def imported_tools(self, path: str) -> None:
        known = self.r["tools"].groupBy("system_id").agg(F.array_sort(F.collect_set(ident("name"))).alias("known"))
        self.put(known, path, 1, said("from tools import ", F.array_join("known", ", "), "\n"))

    def own_tools(self, rows: DataFrame) -> DataFrame:
        """rows with `own`: of their tools those that the system defines, by name."""
        t = self.r["tools"].select("system_id", F.col("tool_key").alias("tool"), F.col("name").alias("as"))
        each = rows.select("system_id", F.col("agent_key"), F.posexplode("tools").alias("k", "tool")).join(t, ["system_id", "tool"])
        own = each.groupBy("system_id", "agent_key").agg(F.expr("transform(array_sort(collect_list(struct(k, `as`))), x -> x.as)").alias("own"))
        return rows.join(own, ["system_id", "agent_key"], "left")

    def tasks_in_order(self) -> DataFrame:
        """tasks with `level`, the number of tasks that each one builds on."""
        t = self.r["tasks"]
        edges = t.select(F.col("system_id"), F.col("task_key").alias("src"), F.explode("context_tasks").alias("dst"))
        behind = transitive(edges, within="system_id").groupBy("system_id", F.col("src").alias("task_key")).agg(F.count(F.lit(1)).alias("level"))
        return t.join(behind, ["system_id", "task_key"], "left").fillna(0, ["level"]).withColumn("at", F.concat_ws("\x1f", F.lpad(F.col("level").cast("string"), 9, "0"), "task_key"))

    # state graphs

    def state_graph(self) -> None:
        path, r = "main.py", self.r
        self.tools(decorated=True)
        self.put(r["systems"], path, 0, F.lit("from typing import TypedDict\n\nfrom langchain_core.messages import HumanMessage, SystemMessage\nfrom langchain_openai import ChatOpenAI\nfrom langgraph.checkpoint.memory import MemorySaver\nfrom langgraph.graph import END, START, StateGraph\n"))
        self.imported_tools(path)
        model = r["agents"].where(filled("llm")).groupBy("system_id").agg(F.min("llm").alias("llm"))
        self.put(r["systems"].join(model, "system_id", "left"), path, 2, said("\nllm = ChatOpenAI(model=", plain(F.coalesce("llm", F.lit("gpt-4o"))), ")\n"))
        flow = r["flows"].groupBy("system_id").agg(F.min_by(F.struct("state_model", "state_fields"), "class_name").alias("f")).select("system_id", "f.*")
        flow = r["systems"].select("system_id").join(flow, "system_id", "left")
        fields = F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce("state_fields", F.create_map().cast("map<string,string>"))), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)), lambda e: F.concat(F.lit("    "), ident(e["key"]), F.lit(": "), F.when(e["value"].rlike(r"^[A-Za-z_][\w\[\], .|]*$"), e["value"]).otherwise(F.lit("str")), F.lit("\n"))), "")
        state = ident(F.coalesce(F.nullif("state_model", F.lit("")), F.lit("State")))
        self.put(flow, path, 4, said("\n\nclass ", state, "(TypedDict):\n", F.coalesce(F.nullif(fields, F.lit("")), F.lit("    pass\n"))))
        agents = self.own_tools(r["agents"]).withColumn("bound", F.size(F.coalesce("own", F.array().cast("array<string>"))) > 0)
        self.put(agents.where("bound"), path, 5, said(ident("agent_key"), "_llm = llm.bind_tools(", names("own"), ")\n"), F.col("agent_key"))
        task = r["tasks"].groupBy("system_id", "agent_key").agg(F.min_by(F.struct("description", "expected_output"), "task_key").alias("t"))
        agents = agents.join(task, ["system_id", "agent_key"], "left").withColumn("asks", F.coalesce("t.description", F.lit("")))
        unasked = F.col("asks") == F.concat(F.lit("Perform "), "role", F.lit(" responsibilities"))
        keys = F.transform(F.filter(F.split(F.coalesce("t.expected_output", F.lit("")), ","), lambda k: F.trim(k) != ""), lambda k: F.concat(plain(F.trim(k)), F.lit(": response.content")))
        messages = F.array_join(F.filter(F.array(F.when(filled("backstory"), said("SystemMessage(content=", quoted("backstory"), ")")), F.when((F.col("asks") != "") & ~unasked, said("HumanMessage(content=", quoted("asks"), ")"))), lambda m: m.isNotNull()), ", ")
        goal = when(filled("goal"), "    ", plain("goal"), "\n")
        stop = when(F.coalesce("human_input", F.lit(False)), '    interrupt("continue?")\n')
        self.put(r["agents"].where("human_input").select("system_id").distinct(), path, 1, F.lit("from langgraph.types import interrupt\n"))
        self.put(agents, path, 6, said("\n\ndef ", ident("agent_key"), "(state):\n", goal, stop, "    response = ", F.when(F.col("bound"), F.concat(ident("agent_key"), F.lit("_llm"))).otherwise("llm"), ".invoke([", messages, "])\n    return {", F.array_join(keys, ", "), "}\n"), F.col("agent_key"))
        self.graph_of_steps(path, state, flow)

    def graph_of_steps(self, path: str, state: Column, flow: DataFrame) -> None:
        r = self.r
        steps = r["flow_steps"]
        known = r["agents"].select("system_id", F.col("agent_key").alias("associated_agent_key"), F.lit(True).alias("led"))
        steps = checkpointed(steps.join(known, ["system_id", "associated_agent_key"], "left"))
        order = F.concat_ws("\x1f", F.lpad(F.coalesce("ord", F.lit(0)).cast("string"), 9, "0"), "method_name")
        made = F.when(F.col("led"), ident("associated_agent_key")).otherwise(F.concat(F.lit("step_"), ident("method_name")))
        self.put(steps.where("led is null"), path, 6, said("\n\ndef step_", ident("method_name"), "(state):\n    return {}\n"), F.col("method_name"))
        fans = steps.where("size(edge_mapping) > 0 or (step_type in ('conditional', 'router') and size(return_values) > 0)")
        mapping = F.coalesce(F.when(F.size("edge_mapping") > 0, F.col("edge_mapping")), F.map_from_arrays("return_values", "return_values"))
        keys = F.array_sort(F.map_keys(mapping))
        code = F.when(filled("function_body") & ~F.col("function_body").startswith("routing_function:"), F.regexp_replace(F.col("function_body"), r"(?m)^", "    ")).otherwise(said("    return ", plain(keys[0])))
        self.put(fans, path, 7, said("\n\ndef route_", ident("method_name"), "(state):\n", code, "\n"), F.col("method_name"))
        self.put(flow, path, 8, said("\n\nworkflow = StateGraph(", state, ")\n"))
        self.put(steps, path, 9, said("workflow.add_node(", plain("method_name"), ", ", made, ")\n"), order)
        pairs = F.array_join(F.transform(keys, lambda k: F.concat(plain(k), F.lit(": "), F.when(F.element_at(mapping, k) == "END", "END").otherwise(plain(F.element_at(mapping, k))))), ", ")
        self.put(fans, path, 10, said("workflow.add_conditional_edges(", plain("method_name"), ", route_", ident("method_name"), ", {", pairs, "})\n"), order)
        keyed = steps.select(F.concat_ws("\x1f", "system_id", "flow").alias("flow"), F.col("method_name").alias("name"), F.coalesce("dependencies", F.array().cast("array<string>")).alias("dependencies"), "return_values", "outgoing")
        edges = resolved_edges(keyed).withColumn("system_id", F.split("flow", "\x1f")[0]).select("system_id", "src", "dst").distinct()
        edges = checkpointed(edges.join(fans.select("system_id", F.col("method_name").alias("src")), ["system_id", "src"], "left_anti"))
        self.put(edges, path, 11, said("workflow.add_edge(", plain("src"), ", ", plain("dst"), ")\n"), F.concat_ws("\x1f", "src", "dst"))
        first = Window.partitionBy("system_id").orderBy(order)
        entered = edges.select("system_id", F.col("dst").alias("method_name")).distinct().withColumn("entered", F.lit(True))
        begins = steps.withColumn("k", F.row_number().over(first)).withColumn("any", F.max(F.col("step_type") == "start").over(Window.partitionBy("system_id")))
        self.put(begins.where("step_type = 'start' or (not any and k = 1)"), path, 12, said("workflow.add_edge(START, ", plain("method_name"), ")\n"), order)
        leaves = steps.join(edges.select("system_id", F.col("src").alias("method_name")).distinct(), ["system_id", "method_name"], "left_anti").join(fans.select("system_id", "method_name"), ["system_id", "method_name"], "left_anti")
        self.put(leaves, path, 13, said("workflow.add_edge(", plain("method_name"), ", END)\n"), order)
        memory = r["teams"].groupBy("system_id").agg(F.max("memory").alias("memory"))
        self.put(flow.join(memory, "system_id", "left"), path, 14, said("app = workflow.compile(", when(F.coalesce("memory", F.lit(False)), "checkpointer=MemorySaver()"), ")\n"))

    # group chats

    def group_chat(self) -> None:
        path, r = "main.py", self.r
        self.tools(decorated=False)
        self.put(r["systems"], path, 0, F.lit("import asyncio\n\nfrom autogen_agentchat.agents import AssistantAgent, UserProxyAgent\nfrom autogen_agentchat.conditions import MaxMessageTermination, TextMentionTermination\nfrom autogen_agentchat.teams import RoundRobinGroupChat, SelectorGroupChat, Swarm\nfrom autogen_ext.models.openai import OpenAIChatCompletionClient\n"))
        self.imported_tools(path)
        models = r["agents"].where(filled("llm")).select("system_id", "llm").distinct()
        default = r["systems"].select("system_id", F.lit("gpt-4o").alias("llm")).join(models, "system_id", "left_anti")
        self.put(models.union(default), path, 2, said("\nclient_", ident("llm"), " = OpenAIChatCompletionClient(model=", plain("llm"), ")\n"), F.col("llm"))
        first = models.union(default).groupBy("system_id").agg(F.min("llm").alias("first_llm"))
        agents = self.own_tools(r["agents"]).join(first, "system_id")
        message = F.concat_ws(" ", F.nullif("goal", F.lit("")), F.nullif("backstory", F.lit("")))
        proxy = F.col("agent_type") == "UserProxy"
        rest = said(", model_client=client_", ident(F.coalesce(F.nullif("llm", F.lit("")), "first_llm")), ", system_message=", plain(message), when(filled("description"), ", description=", plain("description")), when(F.size("own") > 0, ", tools=", names("own")))
        self.put(agents, path, 3, said("\n", ident("agent_key"), " = ", F.when(proxy, "UserProxyAgent").otherwise("AssistantAgent"), "(", plain("role"), F.when(proxy, F.lit("")).otherwise(rest), ")\n"), F.col("agent_key"))
        known = r["agents"].select("system_id", F.col("agent_key").alias("member")).distinct()
        members = r["teams"].select("system_id", "team_key", F.posexplode("agent_keys").alias("k", "member")).join(known, ["system_id", "member"])
        members = members.groupBy("system_id", "team_key").agg(F.expr("transform(array_sort(collect_list(struct(k, member))), x -> x.member)").alias("members"))
        teams = r["teams"].join(members, ["system_id", "team_key"], "left")
        kind = F.when(F.col("coordination_pattern").isin("SelectorBased", "Hierarchical"), "SelectorGroupChat").when(F.col("coordination_pattern") == "Swarm", "Swarm").otherwise("RoundRobinGroupChat")
        one = lambda c: F.when((c["type"] == "TurnLimit") & c["max_turns"].isNotNull(), F.concat(F.lit("MaxMessageTermination("), c["max_turns"].cast("string"), F.lit(")"))).when((c["type"] == "EventBased") & (F.coalesce(c["trigger"], F.lit("")) != ""), F.concat(F.lit("TextMentionTermination("), plain(c["trigger"]), F.lit(")")))
        ends = F.array_join(F.filter(F.transform(F.coalesce("termination_conditions", F.from_json(F.lit("[]"), f"array<{CONDITION}>")), one), lambda c: c.isNotNull()), " | ")
        client = when(F.col("coordination_pattern").isin("SelectorBased", "Hierarchical"), ", model_client=client_", ident("first_llm"))
        teams = teams.join(first, "system_id").withColumn("ends", ends)
        self.put(teams, path, 4, said("\nteam_", ident("team_key"), " = ", kind, "(", names("members"), client, when(filled("ends"), ", termination_condition=", F.col("ends")), when(F.col("max_turns").isNotNull(), ", max_turns=", F.col("max_turns").cast("string")), ")\n"), F.col("team_key"))
        run = r["teams"].groupBy("system_id").agg(F.min("team_key").alias("team_key")).join(self.tasks_in_order().groupBy("system_id").agg(F.min_by("description", "at").alias("description")), "system_id", "left")
        self.put(run, path, 5, said("\n\nasync def main():\n    await team_", ident("team_key"), ".run(task=", quoted("description"), ')\n\n\nif __name__ == "__main__":\n    asyncio.run(main())\n'))

    # crews

    def crew(self) -> None:
        path, r = "crew.py", self.r
        self.tools(decorated=True)
        self.put(r["systems"], path, 0, F.lit("from crewai import LLM, Agent, Crew, Process, Task\nfrom crewai.flow.flow import Flow, listen, router, start\n"))
        self.imported_tools(path)
        agents = self.own_tools(r["agents"])
        yes = lambda c: when(F.coalesce(F.col(c), F.lit(False)), f", {c}=True")
        more = said(when(filled("llm"), ", llm=", plain("llm")), when(F.size("own") > 0, ", tools=", names("own")), yes("reasoning"), yes("memory"), when(F.col("verbose").isNotNull(), ", verbose=", F.initcap(F.col("verbose").cast("string"))), when(F.col("allow_delegation").isNotNull(), ", allow_delegation=", F.initcap(F.col("allow_delegation").cast("string"))))
        self.put(agents, path, 2, said("\n", ident("agent_key"), " = Agent(role=", plain("role"), ", goal=", plain("goal"), ", backstory=", plain("backstory"), more, ")\n"), F.col("agent_key"))
        known = r["agents"].select("system_id", "agent_key", F.lit(True).alias("known")).distinct()
        tasks = self.tasks_in_order().join(known, ["system_id", "agent_key"], "left")
        context = when(F.size("context_tasks") > 0, ", context=", names(F.transform("context_tasks", lambda k: F.concat(F.lit("task_"), k))))
        self.put(tasks, path, 3, said("\ntask_", ident("task_key"), " = Task(description=", quoted("description"), ", expected_output=", quoted("expected_output"), when(F.col("known"), ", agent=", ident("agent_key")), context, yes("human_input"), ")\n"), F.col("at"))
        there = r["tasks"].select("system_id", F.col("task_key").alias("task")).distinct()
        whole = r["teams"].select("system_id", "team_key", F.posexplode("task_keys").alias("k", "task")).join(there, ["system_id", "task"]).groupBy("system_id", "team_key").agg(F.expr("transform(array_sort(collect_list(struct(k, task))), x -> concat('task_', x.task))").alias("works"))
        members = r["teams"].select("system_id", "team_key", F.posexplode("agent_keys").alias("k", "agent_key")).join(known, ["system_id", "agent_key"]).groupBy("system_id", "team_key").agg(F.expr("transform(array_sort(collect_list(struct(k, agent_key))), x -> x.agent_key)").alias("members"))
        teams = r["teams"].join(whole, ["system_id", "team_key"], "left").join(members, ["system_id", "team_key"], "left")
        process = F.when(F.coalesce("process", F.lit("sequential")) == "sequential", "sequential").otherwise("hierarchical")
        self.put(teams, path, 4, said("\n", ident("team_key"), "_crew = Crew(agents=", names("members"), ", tasks=", names("works"), ", process=Process.", process, when(filled("manager_llm"), ", manager_llm=", plain("manager_llm")), yes("verbose"), ")\n"), F.col("team_key"))
        steps = r["flow_steps"]
        self.put(r["flows"], path, 5, said("\n\nclass ", ident("class_name"), "(Flow):\n    pass\n"), F.concat(ident("class_name"), F.lit("\x1f")))
        waits = F.array_join(F.transform(F.filter(F.coalesce("dependencies", F.array().cast("array<string>")), lambda d: d != ""), plain), ", ")
        mark = F.when((F.col("step_type") == "start") | (waits == ""), "@start()").when(F.col("step_type").isin("conditional", "router"), said("@router(", waits, ")")).otherwise(said("@listen(", waits, ")"))
        own = filled("function_body") & ~F.col("function_body").startswith("routing_function:")
        code = F.when(own, F.regexp_replace(F.col("function_body"), r"(?m)^", "        ")).when(F.size("return_values") > 0, said("        return ", plain(F.col("return_values")[0]))).otherwise("        pass")
        order = F.concat_ws("\x1f", ident("flow"), F.lit("m"), F.lpad(F.coalesce("ord", F.lit(0)).cast("string"), 9, "0"))
        self.put(steps, path, 5, said("\n    ", mark, "\n    def ", ident("method_name"), "(self):\n", code, "\n"), order)

    def files(self) -> DataFrame:
        pieces = reduce(DataFrame.unionByName, self.pieces)
        whole = pieces.groupBy("system_id", "path").agg(F.expr("transform(array_sort(collect_list(struct(section, at, text))), x -> x.text)").alias("texts"))
        return whole.select("system_id", "path", F.array_join("texts", "").alias("content"))


def emitted(records: dict[str, DataFrame], framework: str) -> DataFrame:
    """system_id, path, content, error: the sources of each system's records as a program of a framework.

    error is null where the file parses, else what is wrong with it: a stored routing body, say, that is no
    Python. Agents and tasks that nothing names are written too; tools that a system does not define are left
    out; null texts read as empty; systems without records of a kind have no such part."""
    if framework not in FRAMEWORKS:
        raise ValueError(f"framework must be one of {', '.join(FRAMEWORKS)}")
    emitter = Emitter(records)
    {"LangGraph": emitter.state_graph, "AutoGen": emitter.group_chat, "CrewAI": emitter.crew}[framework]()
    return checked(emitter.files())


def checked(files: DataFrame) -> DataFrame:
    """files (system_id, path, content) with the error of those that do not parse."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            errors = []
            for path, content in zip(f.path, f.content, strict=True):
                try:
                    ast.parse(content)
                    errors.append(None)
                except (SyntaxError, ValueError) as e:
                    errors.append(f"{path}: {e}")
            yield f.assign(error=pd.Series(errors, dtype="object"))

    return files.mapInPandas(run, "system_id string, path string, content string, error string")
