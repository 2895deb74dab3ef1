"""Conversations as descriptions of agent programs: records, their graph, the named questions, and records again.

Every conversation is a system: its roles are agents, its turns are tasks of one team and steps of one
flow. Each query has a plain SQL twin over the same table, so that lifting, the 35 questions and lowering
are compared row by row at every size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..operators.closure import checkpointed
from ..operators.graph import TripleStore
from ..operators.lift import lifted
from ..operators.lower import lowered
from . import catalog

NONE = "-"
MODEL = '{"properties": {"text": {"type": "str"}}}'


def records(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The records of all conversations, a DataFrame for each kind."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    turns = turns.withColumn("system_id", F.concat(F.lit("c"), "conv_id"))
    number = F.col("turn").cast("string")
    before, after = (F.col("turn") - 1).cast("string"), (F.col("turn") + 1).cast("string")
    is_role = lambda r: F.col("role") == r
    many = lambda *xs: F.array(*[F.lit(x) for x in xs])
    none = F.array().cast("array<string>")

    agents = turns.groupBy("system_id", "conv_id", "role").agg(F.count(F.lit(1)).alias("n"), F.min_by("text", "turn").alias("first"))
    agents = agents.select(
        "system_id",
        F.col("role").alias("agent_key"),
        F.upper("role").alias("role"),
        F.when(~is_role("system"), F.concat(F.lit("say "), "n")).alias("goal"),
        F.col("first").alias("backstory"),
        F.when(is_role("assistant"), "model 1").alias("llm"),
        F.when(is_role("assistant"), many("search", "web")).otherwise(none).alias("tools"),
        is_role("assistant").alias("reasoning"),
        F.when(is_role("assistant"), 3).alias("max_reasoning_attempts"),
        F.when(F.col("conv_id") % 2 == 0, "ReAct").alias("reasoning_pattern"),
        is_role("assistant").alias("memory"),
        F.lit("buffer").alias("memory_type"),
        (F.col("conv_id") % 2 == 0).alias("verbose"),
        F.when(is_role("system"), many("notes.md")).otherwise(none).alias("knowledge_sources"),
        F.when(is_role("user"), "UserProxy").otherwise("Assistant").alias("agent_type"),
        F.lit("asks").alias("description"),
        F.when(is_role("user"), "ModelDirective").when(is_role("assistant"), "DualDirective").alias("directive_function"),
        is_role("user").alias("human_input"),
    )
    tasks = turns.select(
        "system_id",
        F.concat(F.lit("t"), number).alias("task_key"),
        F.col("text").alias("description"),
        F.when(is_role("user"), "reply").alias("expected_output"),
        F.col("role").alias("agent_key"),
        F.when(is_role("assistant"), many("search")).otherwise(none).alias("tools"),
        F.when(is_role("assistant") & (F.col("turn") > 0), F.array(F.concat(F.lit("t"), before))).otherwise(none).alias("context_tasks"),
        F.when(is_role("assistant"), "Reply").alias("output_pydantic"),
        is_role("user").alias("human_input"),
        F.when(F.col("turn") == 1, many("FunctionBased:check", "LLMBased:be kind")).otherwise(none).alias("guardrails"),
        F.when(F.col("turn") == 1, 2).alias("guardrail_max_retries"),
        F.when(is_role("system"), "Delegated").alias("delegation_strategy"),
        F.lit("text").alias("source_attribute"),
    )
    steps = turns.withColumn("asks", is_role("user") & (F.col("turn") > 0)).select(
        "system_id",
        F.lit("Flow").alias("flow"),
        F.col("turn").cast("int").alias("ord"),
        F.concat(F.lit("s"), number).alias("method_name"),
        F.when(F.col("turn") == 0, "start").when(F.col("asks"), "conditional").otherwise("regular").alias("step_type"),
        F.when(F.col("turn") > 0, F.array(F.concat(F.lit("s"), before))).otherwise(none).alias("dependencies"),
        F.when(F.col("asks"), "pick").alias("function_body"),
        F.when(F.col("asks"), F.create_map(F.lit("next"), F.concat(F.lit("s"), after))).alias("edge_mapping"),
        F.col("role").alias("associated_agent_key"),
    )
    # A conversation has few turns; what is collected here is the list that the record itself holds.
    whole = turns.groupBy("system_id", "conv_id").agg(F.array_sort(F.collect_set("role")).alias("roles"), F.transform(F.array_sort(F.collect_list("turn")), lambda x: F.concat(F.lit("t"), x)).alias("task_keys"))
    condition = lambda kind, trigger, most: F.struct(F.lit(kind).alias("type"), F.lit(trigger).cast("string").alias("trigger"), most.cast("int").alias("max_turns"), F.lit(None).cast("string").alias("operator"), F.lit(None).cast("array<struct<type:string,trigger:string,max_turns:int>>").alias("conditions"))
    teams = whole.select(
        "system_id",
        F.lit("talk").alias("team_key"),
        F.lit("Talk").alias("team_class_name"),
        F.concat("roles", many("ghost")).alias("agent_keys"),
        "task_keys",
        F.lit("sequential").alias("process"),
        (F.col("conv_id") % 2 == 0).alias("memory"),
        F.when(F.col("conv_id") % 5 == 0, "boss").alias("manager_llm"),
        F.array(condition("EventBased", "STOP", F.lit(None)), condition("TurnLimit", None, F.size("task_keys"))).alias("termination_conditions"),
    )
    tools = whole.select("system_id", F.lit("search").alias("tool_key"), F.lit("SearchTool").alias("class_name"), F.lit("search").alias("name"), F.lit("finds").alias("description"), F.lit("{}").alias("args_schema_json"), F.lit("search.py").alias("implementation_ref"))
    flows = whole.select("system_id", F.lit("Flow").alias("class_name"), F.lit("State").alias("state_model"), many("talk").alias("crew_references"), F.create_map(F.lit("topic"), F.lit("str")).alias("state_fields"))
    systems = whole.select("system_id", F.concat(F.lit("conv "), "conv_id").alias("name"), F.when(F.col("conv_id") % 3 == 0, "First").otherwise("Second").alias("framework"), F.concat(F.lit("http://example.org/"), "system_id").alias("namespace"))
    models = whole.select("system_id", F.lit("Reply").alias("class_name"), F.lit(MODEL).alias("schema_json"))
    return {"systems": systems, "agents": agents, "tasks": tasks, "tools": tools, "teams": teams, "flows": flows, "flow_steps": steps, "models": models}


_LIFTED: dict[tuple[str, str, int], DataFrame] = {}


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triples of all conversations, written once a session and state of the folder's files.

    A part's rows lie by predicate and object, so that a pattern reads its own pages and passes over the others."""
    file = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = file.agg(F.bit_xor(F.xxhash64(*file.columns))).first()[0] or 0
    key = (spark.sparkContext.applicationId, sf_dir, state)
    if key not in _LIFTED:
        _LIFTED[key] = checkpointed(lifted(spark, records(spark, sf_dir)).sortWithinPartitions("p", "o"))
    return _LIFTED[key]


def _asked(*numbers: int):
    """question, row: the rows of some questions, with the lexical forms of their columns in order."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = TripleStore(graph(spark, sf_dir).select("s", "p", "o"))
        vocabulary, parts = catalog.detect(store.triples), []
        for n in numbers:
            rows = catalog.run(n, store, vocabulary, ordered=False)  # rows of several questions have no order together
            cells = [F.coalesce(T.lexical(F.col(c)), F.lit(NONE)) for c in rows.columns]
            parts.append(rows.select(F.lit(n).alias("question"), F.concat_ws("|", *cells).alias("row")))
        return reduce(DataFrame.unionByName, parts)

    return run


def _joined(c: str) -> str:
    return f"array_join({c}, ',') AS {c}"


def _back(kind: str, *columns: str):
    """Records of a kind that were lifted and lowered again."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lowered(graph(spark, sf_dir), kinds=(kind,), kept=True)[kind].selectExpr("system_id", *columns)

    return run


#: Kinds of which a system has few records, with what lowered_parts shows of them.
PARTS = {
    "systems": ("name", "framework", "namespace"),
    "tools": ("tool_key", "class_name", "name", "description", "args_schema_json", "implementation_ref"),
    "flows": ("class_name", "state_model", "crew_references", "state_fields"),
    "models": ("class_name", "schema_json"),
}


def lowered_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """system_id, kind, row: systems, tools, flows and models that were lifted and lowered again."""
    back, out = lowered(graph(spark, sf_dir), kinds=tuple(PARTS), kept=True), []
    for kind, columns in PARTS.items():
        shown = {"crew_references": F.array_join("crew_references", ","), "state_fields": F.to_json("state_fields")}
        cells = [F.coalesce(shown.get(c, F.col(c)), F.lit(NONE)) for c in columns]
        out.append(back[kind].select("system_id", F.lit(kind).alias("kind"), F.concat_ws("|", *cells).alias("row")))
    return reduce(DataFrame.unionByName, out)


def lifted_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """class, property, n: how many triples of each property the individuals of each class have."""
    t = graph(spark, sf_dir)
    kinds = t.where(F.col("p") == T.TYPE).select("s", T.local_name(F.col("o")).alias("class"))
    return t.where(F.col("p") != T.TYPE).join(kinds, "s").groupBy("class", T.local_name(F.col("p")).alias("property")).agg(F.count(F.lit(1)).alias("n"))


AGENT_QUESTIONS = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 25, 26, 27, 28)
TASK_QUESTIONS = (11, 12, 13, 14, 15, 16, 17, 33, 34, 35)
TEAM_QUESTIONS = (18, 19, 20, 21, 22, 23, 24, 29, 30, 31, 32)

QUERIES = {
    "catalog_agents": _asked(*AGENT_QUESTIONS),
    "catalog_tasks": _asked(*TASK_QUESTIONS),
    "catalog_teams": _asked(*TEAM_QUESTIONS),
    "lifted_uses": lifted_uses,
    "lowered_parts": lowered_parts,
    "lowered_agents": _back("agents", "agent_key", "role", "goal", "backstory", "llm", _joined("tools"), "reasoning", "max_reasoning_attempts", "memory", "memory_type", "memory_persistence", "verbose", _joined("knowledge_sources"), "agent_type", "description", "directive_function", "reasoning_origin", "reasoning_pattern"),
    "lowered_tasks": _back("tasks", "task_key", "description", "expected_output", "agent_key", _joined("tools"), _joined("context_tasks"), "output_pydantic", "human_input", _joined("guardrails"), "guardrail_max_retries", "delegation_strategy", "source_attribute"),
    "lowered_teams": _back("teams", "team_key", "team_class_name", _joined("agent_keys"), _joined("task_keys"), "process", "memory", "max_turns", "coordination_pattern", "array_join(transform(termination_conditions, c -> concat_ws(':', c.type, c.trigger, cast(c.max_turns as string))), ',') AS termination_conditions"),
    "lowered_steps": _back("flow_steps", "flow", "ord", "method_name", "step_type", _joined("dependencies"), "function_body", "associated_agent_key", "edge_mapping['next'] AS next", _joined("outgoing")),
}

_BASE = (
    "WITH t AS (SELECT *, 'c' || conv_id AS system_id, 'http://example.org/c' || conv_id || '#' AS ns, max(turn) OVER (PARTITION BY conv_id) AS latest FROM conversations), "
    "a AS (SELECT conv_id, system_id, ns, role, count(*) AS n, min_by(text, turn) AS said FROM t GROUP BY ALL), "
    "c AS (SELECT conv_id, system_id, ns, count(*) AS n FROM t GROUP BY ALL), "
    "m AS (SELECT * FROM c WHERE conv_id % 5 = 0) "
)
_EXT = "urn:agents:extension#"
_AGENT, _BOSS, _TASK, _TEAM = "ns || 'Agent_' || role", "ns || 'Agent_manager_talk'", "ns || 'Task_t' || turn", "ns || 'Team_talk'"

#: question: selects of (columns of a row; from and where).
_ROWS: dict[int, tuple[tuple[tuple[str, ...], str], ...]] = {
    1: ((("ns || 'conv_' || conv_id", _AGENT), "a"), (("ns || 'conv_' || conv_id", _BOSS), "m")),
    2: (((_AGENT, "role", "upper(role)"), "a"), ((_BOSS, "'manager_talk'", "'Manager'"), "m")),
    3: (((_AGENT, "CASE role WHEN 'user' THEN 'UserProxy' ELSE 'Assistant' END"), "a"), ((_BOSS, "'Manager'"), "m")),
    4: (
        ((_AGENT, "'orchestration'", "ns || 'AgentPrompt_' || role"), "a"),
        ((_AGENT, "'orchestration'", "ns || 'OrchestratorPrompt_user'"), "a WHERE role = 'user'"),
        ((_AGENT, "'language-model'", "ns || 'TaskPrompt_t' || turn"), "t"),
    ),
    5: (
        (("ns || 'AgentPrompt_' || role", "CASE role WHEN 'user' THEN 'ModelDirective' ELSE 'DualDirective' END"), "a WHERE role <> 'system'"),
        (("ns || 'OrchestratorPrompt_user'", "'OrchestratorDirective'"), "a WHERE role = 'user'"),
    ),
    6: (
        ((_AGENT, "ns || 'AgentPrompt_' || role", "CASE role WHEN 'user' THEN 'say ' || n WHEN 'assistant' THEN 'ASSISTANT: say ' || n END", "said", "NULL"), "a"),
        ((_AGENT, "ns || 'OrchestratorPrompt_user'", "'asks'", "NULL", "NULL"), "a WHERE role = 'user'"),
    ),
    7: (
        ((_AGENT, "'yes'", "'yes'", "CASE role WHEN 'assistant' THEN 'yes' ELSE 'no' END", "'yes'", "CASE role WHEN 'system' THEN 'no' ELSE 'yes' END"), "a"),
        ((_AGENT, "'yes'", "'yes'", "'no'", "'yes'", "'yes'"), "a WHERE role = 'user'"),
        ((_BOSS, "'yes'", "'yes'", "'yes'", "'no'", "'no'"), "m"),
    ),
    8: (((_AGENT, "'yes'", *["CASE role WHEN 'assistant' THEN 'yes' ELSE 'no' END"] * 2), "a"), ((_BOSS, "'yes'", "'no'", "'no'"), "m")),
    9: (((_AGENT, "CASE role WHEN 'user' THEN 'true' ELSE 'false' END"), "a"), ((_BOSS, "'false'"), "m")),
    10: (((_AGENT, "CASE role WHEN 'user' THEN 'human-proxy' ELSE 'worker' END"), "a"), ((_BOSS, "'manager'"), "m")),
    11: (((_TASK, "NULL", "text"), "t"),),
    12: (((_TASK, _AGENT), "t"),),
    13: (((_TASK, "'Delegated'"), "t WHERE role = 'system'"),),
    14: (((_TASK, "ns || 'Task_t' || (turn - 1)"), "t WHERE turn > 0"),),
    15: (((_TASK, "ns || 'Task_t' || (turn - 1)", "CASE role WHEN 'assistant' THEN 'ContextProviding' ELSE 'Sequential' END"), "t WHERE turn > 0"),),
    16: (((_TASK, "'reply'"), "t WHERE role = 'user'"),),
    17: (((_TASK, "ns || 'Schema_Reply'", f"'{MODEL}'"), "t WHERE role = 'assistant'"), (("ns || 'Orchestration_Flow'", "ns || 'StateSchema_Flow'", "'{\"topic\": \"str\"}'"), "c")),
    18: (((_TEAM, f"'{_EXT}Sequential'"), "c"),),
    19: (((_TEAM, _AGENT), "a"), ((_TEAM, _BOSS), "m")),
    20: (((_TEAM, f"'{_EXT}Sequential'", _AGENT), "a"), ((_TEAM, f"'{_EXT}Sequential'", _BOSS), "m")),
    21: (((_TEAM, "ns || 'EventTermination_talk_0'", f"'{_EXT}EventBasedTermination'"), "c"), ((_TEAM, "ns || 'TurnLimit_talk_1'", f"'{_EXT}TurnLimitTermination'"), "c")),
    22: ((("ns || 'conv_' || conv_id", _TEAM), "c"), (("ns || 'Orchestration_Flow'", _TEAM), "c")),
    23: tuple(((f"ns || '{pattern}'", f"ns || '{step}' || turn", "CAST(turn + 1 AS VARCHAR)", f"CASE WHEN turn < latest THEN ns || '{step}' || (turn + 1) END"), "t") for pattern, step in (("WorkflowPattern_talk", "CrewStep_talk_t"), ("FlowWorkflowPattern_Flow", "FlowStep_s"))),
    24: ((("ns || 'FlowStep_s' || turn", "'{\"next\": \"s' || (turn + 1) || '\"}'", "'pick'"), "t WHERE role = 'user' AND turn > 0"),),
    25: (((_AGENT, "CASE role WHEN 'assistant' THEN 'true' ELSE 'false' END"), "a"), ((_BOSS, "NULL"), "m")),
    26: (((_AGENT, "ns || 'ReasoningPattern_' || k", f"'{_EXT}' || k"), "(SELECT *, CASE conv_id % 2 WHEN 0 THEN 'ReAct' ELSE 'Unspecified' END AS k FROM a WHERE role = 'assistant')"),),
    27: (((_AGENT, "'FrameworkManaged'"), "a WHERE role = 'assistant'"),),
    28: (((_AGENT, "'agent-private'", "ns || 'MemoryBinding_AgentPrivate_assistant'", "ns || 'Memory_AgentPrivate_assistant'", "'AgentPrivate'"), "a WHERE role = 'assistant'"),),
    29: ((("ns || 'Memory_AgentPrivate_assistant'", "'Persistent'"), "a WHERE role = 'assistant'"), (("ns || 'Memory_GroupShared_talk'", "'Persistent'"), "c WHERE conv_id % 2 = 0")),
    30: ((("ns || 'Tool_SearchTool'", "'search'"), "c"), (("ns || 'Tool_web'", "'web'"), "a WHERE role = 'assistant'")),
    31: ((("ns || 'Tool_SearchTool'", "'{}'"), "c"),),
    32: (((_AGENT, "ns || 'Tool_SearchTool'"), "a WHERE role = 'assistant'"), ((_AGENT, "ns || 'Tool_web'"), "a WHERE role = 'assistant'")),
    33: (((_TASK, "ns || 'Tool_SearchTool'"), "t WHERE role = 'assistant'"),),
    34: (((_TASK, "ns || 'Guardrail_t1_0'", "'FunctionBased'", "'check'", "'2'"), "t WHERE turn = 1"), ((_TASK, "ns || 'Guardrail_t1_1'", "'LLMBased'", "NULL", "'2'"), "t WHERE turn = 1")),
    35: (((_TASK, "ns || 'HumanCheckpoint_t' || turn", "'AfterExecution'", "'Review'", "'true'"), "t WHERE role = 'user'"), ((_AGENT, "ns || 'HumanCheckpoint_user'", "NULL", "'InputRequest'", "'true'"), "a WHERE role = 'user'")),
}


def _asked_sql(*numbers: int) -> str:
    cells = lambda xs: " || '|' || ".join(f"coalesce({x}, '{NONE}')" for x in xs)
    return _BASE + " UNION ALL ".join(f"SELECT {n} AS question, {cells(xs)} AS row FROM {source}" for n in numbers for xs, source in _ROWS[n])


#: class: (where its individuals come from, {property: how many there are, as a sum over these}).
_USES: dict[str, tuple[str, dict[str, str]]] = {
    "AgenticSystem": ("c", {"hasTitle": "1", "hasSourceFramework": "1", "containsTeam": "1", "containsOrchestration": "1", "containsAgent": "(SELECT count(*) FROM a WHERE a.conv_id = c.conv_id) + (conv_id % 5 = 0)::INT"}),
    "LLMAgent": (
        "(SELECT conv_id, role FROM a UNION ALL SELECT conv_id, 'manager' FROM m)",
        {
            "agentID": "1", "agentRole": "1", "agentType": "1", "hasReasoningEnabled": "(role <> 'manager')::INT", "hasAgentGoal": "(role IN ('user', 'assistant'))::INT", "agentPrompt": "(role <> 'manager')::INT + (role = 'user')::INT",
            "useLanguageModel": "(role IN ('assistant', 'manager'))::INT", "hasAgentConfig": "(role <> 'manager')::INT", "employsReasoningPattern": "(role = 'assistant')::INT", "hasReasoningOrigin": "(role = 'assistant')::INT",
            "hasMaxReasoningAttempts": "(role = 'assistant')::INT", "hasMemoryBinding": "(role = 'assistant')::INT", "hasKnowledge": "(role = 'system')::INT", "hasHumanCheckpoint": "(role = 'user')::INT", "agentToolUsage": "2 * (role = 'assistant')::INT",
        },
    ),
    "Task": (
        "t",
        {
            "hasExpectedOutput": "(role = 'user')::INT", "hasDelegationStrategy": "(role = 'system')::INT", "taskPrompt": "1", "performedByAgent": "1", "dependsOn": "(turn > 0)::INT", "hasDependencyType": "(turn > 0)::INT", "taskToolUsage": "(role = 'assistant')::INT",
            "hasOutputSchema": "(role = 'assistant')::INT", "hasGuardrail": "2 * (turn = 1)::INT", "hasHumanCheckpoint": "(role = 'user')::INT",
        },
    ),
    "Tool": ("(SELECT 1 AS known FROM c UNION ALL SELECT 0 FROM a WHERE role = 'assistant')", {"hasTitle": "1", "hasDescription": "known", "hasInputSchema": "known", "hasImplementationReference": "known", "hasReference": "1 - known"}),
    "Goal": ("a WHERE role <> 'system'", {"hasDescription": "1"}),
    "Prompt": (
        "(SELECT role AS kind FROM a UNION ALL SELECT 'second' FROM a WHERE role = 'user' UNION ALL SELECT CASE role WHEN 'user' THEN 'asked' ELSE 'task' END FROM t)",
        {"promptInstruction": "(kind <> 'system')::INT", "promptContext": "(kind IN ('system', 'user', 'assistant'))::INT", "hasDirectiveFunction": "(kind IN ('user', 'assistant', 'second'))::INT", "hasSourceAttribute": "(kind IN ('second', 'asked', 'task'))::INT", "promptOutputIndicator": "(kind = 'asked')::INT"},
    ),
    "LanguageModel": ("(SELECT 1 FROM a WHERE role = 'assistant' UNION ALL SELECT 1 FROM m)", {"hasTitle": "1"}),
    "Config": ("a", {"configKey": "1", "configValue": "1"}),
    "MemoryBinding": ("(SELECT 1 FROM a WHERE role = 'assistant' UNION ALL SELECT 1 FROM c WHERE conv_id % 2 = 0)", {"hasMemoryScope": "1", "bindsMemory": "1"}),
    "Memory": ("(SELECT 1 AS own FROM a WHERE role = 'assistant' UNION ALL SELECT 0 FROM c WHERE conv_id % 2 = 0)", {"hasPersistenceScope": "1", "hasTitle": "own"}),
    "KnowledgeBase": ("a WHERE role = 'system'", {"hasTitle": "1"}),
    "HumanCheckpoint": ("(SELECT 1 AS task FROM t WHERE role = 'user' UNION ALL SELECT 0 FROM a WHERE role = 'user')", {"hasCheckpointType": "1", "isMandatory": "1", "hasCheckpointPosition": "task"}),
    "Guardrail": ("(SELECT unnest([1, 0]) AS coded FROM t WHERE turn = 1)", {"hasGuardrailType": "1", "hasValidationLogic": "coded", "hasDescription": "1 - coded", "hasMaxRetries": "1"}),
    "Schema": ("(SELECT 1 FROM a WHERE role = 'assistant' UNION ALL SELECT 1 FROM c)", {"hasSchemaDefinition": "1", "hasTitle": "1", "hasSourceAttribute": "1"}),
    "Team": ("c", {"hasTitle": "1", "hasAgentMember": "(SELECT count(*) FROM a WHERE a.conv_id = c.conv_id) + (conv_id % 5 = 0)::INT", "employsCoordinationPattern": "1", "hasTerminationCondition": "2", "hasWorkflowPattern": "1", "hasTeamMemoryBinding": "(conv_id % 2 = 0)::INT"}),
    "EventBasedTermination": ("c", {"hasTriggerExpression": "1"}),
    "TurnLimitTermination": ("c", {"hasMaxTurns": "1"}),
    "WorkflowPattern": ("c", {"hasWorkflowStep": "2 * n"}),
    "Orchestration": ("c", {"hasTitle": "1", "hasWorkflowPattern": "1", "employsCoordinationPattern": "1", "hasOutputSchema": "1", "orchestratesTeam": "1"}),
}
_CREW = {"hasTitle": "1", "stepOrder": "1", "hasAssociatedTask": "1", "nextStep": "(turn < latest)::INT"}
_FLOW = {"hasTitle": "1", "stepOrder": "1", "hasAssociatedAgent": "1", "nextStep": "(turn < latest)::INT", "hasRoutingLogic": "asks", "hasEdgeMapping": "asks"}
_STEPS = "(SELECT *, (role = 'user' AND turn > 0)::INT AS asks FROM t)"
#: The steps' classes: (class, where, properties); a flow's step is a WorkflowStep and may be of another class too.
_STEP_USES = (
    ("StartStep", f"{_STEPS} WHERE turn = 0", _CREW),
    ("EndStep", f"{_STEPS} WHERE turn = latest", _CREW),
    ("WorkflowStep", f"{_STEPS} WHERE turn > 0 AND turn < latest", _CREW),
    ("WorkflowStep", _STEPS, _FLOW),
    ("StartStep", f"{_STEPS} WHERE turn = 0", _FLOW),
    ("ConditionalStep", f"{_STEPS} WHERE asks = 1", _FLOW),
    ("EndStep", f"{_STEPS} WHERE turn = latest AND turn > 0 AND asks = 0", _FLOW),
)


def _uses_sql() -> str:
    rows = [(k, source, p, n) for k, (source, uses) in _USES.items() for p, n in uses.items()] + [(k, source, p, n) for k, source, uses in _STEP_USES for p, n in uses.items()]
    parts = " UNION ALL ".join(f"SELECT '{k}' AS class, '{p}' AS property, (SELECT sum({n}) FROM {source}) AS n" for k, source, p, n in rows)
    return f"{_BASE} SELECT class, property, CAST(sum(n) AS BIGINT) AS n FROM ({parts}) GROUP BY ALL HAVING sum(n) > 0"


def _told(select: str, source: str) -> str:
    return f"{_BASE} SELECT system_id, {select} FROM {source}"


_BY = lambda x, then, other="NULL": f"CASE WHEN {x} THEN {then} ELSE {other} END"
_HELPER = "role = 'assistant'"

ORACLES = {
    "catalog_agents": _asked_sql(*AGENT_QUESTIONS),
    "catalog_tasks": _asked_sql(*TASK_QUESTIONS),
    "catalog_teams": _asked_sql(*TEAM_QUESTIONS),
    "lifted_uses": _uses_sql(),
    "lowered_parts": _BASE
    + " UNION ALL ".join(
        (
            "SELECT system_id, 'systems' AS kind, 'conv ' || conv_id || '|' || CASE conv_id % 3 WHEN 0 THEN 'First' ELSE 'Second' END || '|' || ns AS row FROM c",
            "SELECT system_id, 'tools', 'SearchTool|SearchTool|search|finds|{}|search.py' FROM c",
            "SELECT system_id, 'tools', 'web|web|web|-|-|-' FROM a WHERE role = 'assistant'",
            "SELECT system_id, 'flows', 'Flow|State|talk|{\"topic\":\"str\"}' FROM c",
            f"SELECT system_id, 'models', 'Reply|{MODEL}' FROM a WHERE role = 'assistant'",
            "SELECT system_id, 'models', 'State|{\"topic\": \"str\"}' FROM c",
        )
    ),
    "lowered_agents": _told(
        f"role AS agent_key, upper(role) AS role, CASE WHEN role <> 'system' THEN 'say ' || n END AS goal, said AS backstory, {_BY(_HELPER, "'model 1'")} AS llm, {_BY(_HELPER, "'SearchTool,web'", "''")} AS tools, "
        f"{_HELPER} AS reasoning, CAST({_BY(_HELPER, '3')} AS INTEGER) AS max_reasoning_attempts, {_HELPER} AS memory, {_BY(_HELPER, "'buffer'")} AS memory_type, {_BY(_HELPER, "'Persistent'")} AS memory_persistence, conv_id % 2 = 0 AS verbose, "
        "CASE role WHEN 'system' THEN 'notes.md' ELSE '' END AS knowledge_sources, CASE role WHEN 'user' THEN 'UserProxy' ELSE 'Assistant' END AS agent_type, CASE role WHEN 'user' THEN 'asks' END AS description, "
        f"CASE role WHEN 'user' THEN 'ModelDirective' WHEN 'assistant' THEN 'DualDirective' END AS directive_function, {_BY(_HELPER, "'FrameworkManaged'")} AS reasoning_origin, {_BY(_HELPER, "CASE conv_id % 2 WHEN 0 THEN 'ReAct' ELSE 'Unspecified' END")} AS reasoning_pattern",
        "a",
    )
    + " UNION ALL SELECT system_id, 'manager_talk', 'Manager', NULL, NULL, 'boss', '', false, NULL, false, NULL, NULL, NULL, '', 'Manager', NULL, NULL, NULL, NULL FROM m",
    "lowered_tasks": _told(
        f"'t' || turn AS task_key, text AS description, CASE role WHEN 'user' THEN 'reply' END AS expected_output, role AS agent_key, {_BY(_HELPER, "'SearchTool'", "''")} AS tools, {_BY('turn > 0', "'t' || (turn - 1)", "''")} AS context_tasks, "
        f"{_BY(_HELPER, "'Reply'")} AS output_pydantic, role = 'user' AS human_input, {_BY('turn = 1', "'FunctionBased:check,LLMBased:be kind'", "''")} AS guardrails, CAST({_BY('turn = 1', '2')} AS INTEGER) AS guardrail_max_retries, "
        "CASE role WHEN 'system' THEN 'Delegated' END AS delegation_strategy, 'text' AS source_attribute",
        "t",
    ),
    "lowered_teams": _told(
        "'talk' AS team_key, 'Talk' AS team_class_name, (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT role AS k FROM a WHERE a.conv_id = c.conv_id UNION ALL SELECT 'manager_talk' WHERE c.conv_id % 5 = 0)) AS agent_keys, "
        "(SELECT string_agg('t' || turn, ',' ORDER BY turn) FROM t WHERE t.conv_id = c.conv_id) AS task_keys, 'sequential' AS process, conv_id % 2 = 0 AS memory, CAST(n AS INTEGER) AS max_turns, 'Sequential' AS coordination_pattern, 'EventBased:STOP,TurnLimit:' || n AS termination_conditions",
        "c",
    ),
    "lowered_steps": _told(
        f"'Flow' AS flow, CAST(turn AS INTEGER) AS ord, 's' || turn AS method_name, CASE WHEN turn = 0 THEN 'start' WHEN role = 'user' THEN 'conditional' WHEN turn = latest THEN 'end' ELSE 'regular' END AS step_type, {_BY('turn > 0', "'s' || (turn - 1)", "''")} AS dependencies, "
        f"{_BY("role = 'user' AND turn > 0", "'pick'")} AS function_body, role AS associated_agent_key, {_BY("role = 'user' AND turn > 0", "'s' || (turn + 1)")} AS next, {_BY('turn < latest', "'s' || (turn + 1)", "''")} AS outgoing",
        "t",
    ),
}
