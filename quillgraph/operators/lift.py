"""Records to triples. Rules tell what a row of records says; their union is a set.

Rules over the same rows are told by one scan: each row gives an array of triples, and those whose
condition does not hold, or whose object is null or an empty text, are left out. Whether a key exists in
other records is a column that is joined once, before the rules; so rules have no order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import terms as T
from ..plans.catalog import Vocabulary
from .records import SCHEMAS
from .closure import checkpointed
from .workflow import resolved_edges

#: What names mean in the vocabulary.
COORDINATION = ("Sequential", "Hierarchical", "RoundRobin", "SelectorBased", "Swarm", "ReActLoop", "Network", "Custom")
PROCESSES = {"sequential": "Sequential", "hierarchical": "Hierarchical"}
REASONING = ("ReAct", "ChainOfThought", "ReflectionLoop", "TreeOfThoughts")
WITHOUT_STEPS = ("RoundRobin", "SelectorBased", "Swarm", "ReActLoop", "Custom", "Network")
TERMINATION = {"EventBased": ("EventTermination", "EventBasedTermination"), "TurnLimit": ("TurnLimit", "TurnLimitTermination"), "Routing": ("RoutingTermination", "RoutingTermination"), "Composite": ("CompositeTermination", "CompositeTermination")}


def text(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return T.literal_of(F.when(c != "", c))


def number(c: Column | str) -> Column:
    return T.literal_of(F.col(c) if isinstance(c, str) else c, T.XSD + "integer")


def flag(c: Column | str) -> Column:
    return T.literal_of(F.col(c) if isinstance(c, str) else c, T.XSD + "boolean")


def json_of(column: str, keys: Column) -> Column:
    """A map of texts as a JSON object with the keys in the given order."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    pairs = F.transform(keys, lambda k: F.concat(quoted(k), F.lit(": "), quoted(F.element_at(column, k))))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def _complete(spark: SparkSession, records: DataFrame, schema: str) -> DataFrame:
    """All columns of the schema, null where the records have none."""
    want = spark.createDataFrame([], schema).dtypes
    return records.select(*[(F.col(c) if c in records.columns else F.lit(None)).cast(t).alias(c) for c, t in want])


class Lift:
    def __init__(self, spark: SparkSession, records: dict[str, DataFrame], vocabulary: Vocabulary):
        self.v = vocabulary
        empty = {n: spark.createDataFrame([], s) for n, s in SCHEMAS.items() if n not in records}
        systems = checkpointed(_complete(spark, records["systems"], SCHEMAS["systems"]) if "systems" in records else empty["systems"])
        spaces = systems.select("system_id", F.when(F.col("namespace").rlike("[#/]$"), F.col("namespace")).otherwise(F.concat("namespace", F.lit("#"))).alias("ns"))
        self.r = {"systems": systems.join(spaces, "system_id")}
        for n in SCHEMAS:
            if n in records and n != "systems":  # every rule reads some of them
                rows = _complete(spark, records[n], SCHEMAS[n])
                rows = rows.withColumn("team_key", F.coalesce("team_key", "team_class_name")) if n == "teams" else rows
                self.r[n] = checkpointed(rows.join(spaces, "system_id"))
            elif n != "systems":
                self.r[n] = empty[n].withColumn("ns", F.lit(""))
        self.told: dict[int, tuple[DataFrame, list[Column]]] = {}

    def node(self, prefix: str, *key: Column | str) -> Column:
        parts = [T.safe_id(F.col(k) if isinstance(k, str) else k) for k in key]
        return T.iri_of(F.col("ns"), F.concat_ws("_", F.lit(prefix), *parts))

    def emit(self, rows: DataFrame, subject: Column, *facts: tuple[str, Column], kind: str | None = None, where: Column | None = None) -> None:
        """Triples of each row for which the condition holds: (name of a property, object) facts, and the subject's class."""
        subject = subject if where is None else F.when(where, subject)
        of = self.told.setdefault(id(rows), (rows, []))[1]
        of += [F.struct(subject.alias("s"), F.lit(self.v(p)).alias("p"), o.alias("o")) for p, o in facts]
        if kind:
            of.append(F.struct(subject.alias("s"), F.lit(T.TYPE).alias("p"), F.lit(self.v(kind)).alias("o")))

    def known(self, kind: str, key: str, name: str) -> DataFrame:
        return self.r[kind].select("system_id", F.col(key).alias(name)).distinct()

    def tools(self) -> None:
        self.emit(self.r["tools"], self.node("Tool", "class_name"), ("hasTitle", text("name")), ("hasDescription", text("description")), ("hasInputSchema", text("args_schema_json")), ("hasImplementationReference", text("implementation_ref")), kind="Tool")
        own = self.r["tools"].select("system_id", F.col("tool_key").alias("tool"), "class_name").dropDuplicates(["system_id", "tool"])
        for kind, prefix, key, use in (("agents", "Agent", "agent_key", "agentToolUsage"), ("tasks", "Task", "task_key", "taskToolUsage")):
            used = self.r[kind].select("system_id", "ns", key, F.explode("tools").alias("tool")).join(own, ["system_id", "tool"], "left")
            target = self.node("Tool", F.coalesce("class_name", "tool"))
            self.emit(used, self.node(prefix, key), (use, target))
            self.emit(used, target, ("hasTitle", text("tool")), ("hasReference", text(F.concat(F.lit("external:"), F.col("tool")))), kind="Tool", where=F.col("class_name").isNull())

    def agents(self) -> None:
        a = self.r["agents"]
        me = self.node("Agent", "agent_key")
        filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
        self.emit(a, me, ("agentID", text("agent_key")), ("agentRole", text("role")), ("agentType", text("agent_type")), ("hasReasoningEnabled", flag("reasoning")), kind="LLMAgent")
        self.emit(a, self.node("Goal", "agent_key"), ("hasDescription", text("goal")), kind="Goal", where=filled("goal"))
        self.emit(a, me, ("hasAgentGoal", self.node("Goal", "agent_key")), where=filled("goal"))
        directive = F.coalesce("directive_function", F.lit(""))
        prompted = directive.isin("ModelDirective", "DualDirective") | filled("goal") | filled("backstory")
        said = F.when(directive == "DualDirective", F.when(filled("goal"), F.concat("role", F.lit(": "), "goal")).otherwise(F.col("role"))).otherwise(F.col("goal"))
        prompt = self.node("AgentPrompt", "agent_key")
        self.emit(a, prompt, ("promptInstruction", text(said)), ("promptContext", text("backstory")), ("hasDirectiveFunction", text(directive)), ("hasSourceAttribute", text("prompt_source")), kind="Prompt", where=prompted)
        self.emit(a, me, ("agentPrompt", prompt), where=prompted)
        described = (directive == "ModelDirective") & filled("description")
        second = self.node("OrchestratorPrompt", "agent_key")
        self.emit(a, second, ("promptInstruction", text("description")), ("hasDirectiveFunction", text(F.lit("OrchestratorDirective"))), ("hasSourceAttribute", text(F.lit("description"))), kind="Prompt", where=described)
        self.emit(a, me, ("agentPrompt", second), where=described)
        self.model(a, me, "llm", filled("llm"))
        for key in ("verbose", "allow_delegation"):
            self.config(a, F.col(key).isNotNull(), me, F.concat(F.lit("Agent_"), F.col("agent_key")), "hasAgentConfig", key, F.col(key).cast("string"))
        thinking = F.coalesce("reasoning", F.lit(False))
        kind = F.when(F.col("reasoning_pattern").isin(*REASONING), F.col("reasoning_pattern")).otherwise(F.lit("Unspecified"))
        pattern = self.node("ReasoningPattern", kind)
        self.emit(a, me, ("employsReasoningPattern", pattern), ("hasReasoningOrigin", text(F.coalesce(F.when(F.col("reasoning_origin") != "", F.col("reasoning_origin")), F.lit("FrameworkManaged")))), ("hasMaxReasoningAttempts", number("max_reasoning_attempts")), where=thinking)
        self.told[id(a)][1].append(F.struct(F.when(thinking, pattern).alias("s"), F.lit(T.TYPE).alias("p"), T.iri_of(self.v.extension, kind).alias("o")))
        self.memory(a, F.coalesce("memory", F.lit(False)), me, "agent_key", "AgentPrivate", "hasMemoryBinding", F.coalesce(F.when(F.col("memory_persistence") != "", F.col("memory_persistence")), F.lit("Persistent")), F.col("memory_type"))
        self.knowledge(a, me)
        asked = F.coalesce("human_input", F.lit(False))
        stop = self.node("HumanCheckpoint", "agent_key")
        self.emit(a, stop, ("hasCheckpointType", text(F.when(F.col("agent_type") == "UserProxy", "InputRequest").otherwise("Approval"))), ("isMandatory", flag(F.lit(True))), kind="HumanCheckpoint", where=asked)
        self.emit(a, me, ("hasHumanCheckpoint", stop), where=asked)

    def model(self, rows: DataFrame, me: Column, key: str, where: Column) -> None:
        self.emit(rows, self.node("LM", key), ("hasTitle", text(key)), kind="LanguageModel", where=where)
        self.emit(rows, me, ("useLanguageModel", self.node("LM", key)), where=where)

    def config(self, rows: DataFrame, where: Column, me: Column, name: Column, holds: str, key: str, value: Column) -> None:
        node = self.node("Config", F.lit(key), name)
        self.emit(rows, node, ("configKey", text(F.lit(key))), ("configValue", text(value)), kind="Config", where=where)
        self.emit(rows, me, (holds, node), where=where)

    def memory(self, rows: DataFrame, where: Column, me: Column, key: str, scope: str, holds: str, persistence: Column, title: Column | None = None) -> None:
        binding, memory = self.node(f"MemoryBinding_{scope}", key), self.node(f"Memory_{scope}", key)
        self.emit(rows, binding, ("hasMemoryScope", text(F.lit(scope))), ("bindsMemory", memory), kind="MemoryBinding", where=where)
        self.emit(rows, memory, ("hasPersistenceScope", text(persistence)), *([("hasTitle", text(title))] if title is not None else []), kind="Memory", where=where)
        self.emit(rows, me, (holds, binding), where=where)

    def knowledge(self, rows: DataFrame, me: Column) -> None:
        each = rows.withColumn("source", F.explode("knowledge_sources"))
        self.emit(each, self.node("KnowledgeBase", "source"), ("hasTitle", text("source")), kind="KnowledgeBase")
        self.emit(each, me, ("hasKnowledge", self.node("KnowledgeBase", "source")))

    def tasks(self) -> None:
        schemas = self.r["models"].select("system_id", F.col("class_name").alias("output_pydantic"), "schema_json").dropDuplicates(["system_id", "output_pydantic"]).withColumn("shaped", F.lit(True))
        t = self.r["tasks"].join(self.known("agents", "agent_key", "agent_key").withColumn("known", F.lit(True)), ["system_id", "agent_key"], "left").join(schemas, ["system_id", "output_pydantic"], "left")
        me = self.node("Task", "task_key")
        self.emit(t, me, ("hasExpectedOutput", text("expected_output")), ("hasDelegationStrategy", text("delegation_strategy")), ("taskPrompt", self.node("TaskPrompt", "task_key")), kind="Task")
        self.emit(t, me, ("performedByAgent", self.node("Agent", "agent_key")), where=F.col("known"))
        self.emit(t, self.node("TaskPrompt", "task_key"), ("promptInstruction", text("description")), ("promptOutputIndicator", text("expected_output")), ("hasSourceAttribute", text("source_attribute")), kind="Prompt")
        self.schema(t, F.col("shaped"), me, self.node("Schema", "output_pydantic"), F.col("schema_json"), F.col("output_pydantic"), "output_pydantic")
        self.schema(t, F.col("output_json") != "", me, self.node("Schema", F.concat("output_json", F.lit("_json"))), F.lit(None).cast("string"), F.col("output_json"), "output_json")
        after = t.withColumn("before", F.explode("context_tasks"))
        self.emit(after, me, ("dependsOn", self.node("Task", "before")), ("hasDependencyType", text(F.lit("ContextProviding"))))
        self.emit(after, self.node("Task", "before"), kind="Task")
        guards = t.select("system_id", "ns", "task_key", "guardrail_max_retries", F.posexplode("guardrails").alias("i", "rail"))
        rail = self.node("Guardrail", F.concat_ws("_", "task_key", F.col("i").cast("string")))
        tag = F.regexp_extract("rail", "^(FunctionBased|LLMBased):", 1)
        detail = F.regexp_replace("rail", "^(FunctionBased|LLMBased):", "")
        self.emit(guards, rail, ("hasGuardrailType", text(tag)), ("hasValidationLogic", text(F.when(tag == "FunctionBased", detail))), ("hasDescription", text(F.when(tag != "FunctionBased", detail))), ("hasMaxRetries", number("guardrail_max_retries")), kind="Guardrail")
        self.emit(guards, me, ("hasGuardrail", rail))
        asked = F.coalesce("human_input", F.lit(False))
        stop = self.node("HumanCheckpoint", "task_key")
        self.emit(t, stop, ("hasCheckpointType", text(F.lit("Review"))), ("hasCheckpointPosition", text(F.lit("AfterExecution"))), ("isMandatory", flag(F.lit(True))), kind="HumanCheckpoint", where=asked)
        self.emit(t, me, ("hasHumanCheckpoint", stop), where=asked)

    def schema(self, rows: DataFrame, where: Column, me: Column, node: Column, definition: Column, title: Column, source: str) -> None:
        self.emit(rows, node, ("hasSchemaDefinition", text(definition)), ("hasTitle", text(title)), ("hasSourceAttribute", text(F.lit(source))), kind="Schema", where=where)
        self.emit(rows, me, ("hasOutputSchema", node), where=where)

    def teams(self) -> None:
        t = self.r["teams"]
        me = self.node("Team", "team_key")
        self.emit(t, me, ("hasTitle", text("team_class_name")), kind="Team")
        agents = self.known("agents", "agent_key", "member")
        members = t.withColumn("member", F.explode("agent_keys")).join(agents, ["system_id", "member"], "left_semi")
        self.emit(members, me, ("hasAgentMember", self.node("Agent", "member")))
        by_process = F.create_map(*[F.lit(x) for kv in PROCESSES.items() for x in kv])
        pattern = F.when(F.col("coordination_pattern").isin(*COORDINATION), F.col("coordination_pattern")).otherwise(F.coalesce(F.try_element_at(by_process, F.col("process")), F.lit("Custom")))
        self.coordination(t, me, pattern)
        self.terminations(t, me)
        self.steps_of_teams(t, me)
        manager = F.coalesce(F.when(F.col("manager_agent") != "", F.col("manager_agent")), F.concat(F.lit("manager_"), F.col("team_key")))
        led = t.where("coalesce(manager_llm, '') <> '' or coalesce(manager_agent, '') <> ''").withColumn("manager", manager).join(agents.withColumnRenamed("member", "manager"), ["system_id", "manager"], "left_anti")
        self.managers = led.select("system_id", "ns", "manager")
        boss = self.node("Agent", "manager")
        self.emit(led, boss, ("agentID", text("manager")), ("agentRole", text(F.lit("Manager"))), ("agentType", text(F.lit("Manager"))), kind="LLMAgent")
        self.model(led, boss, "manager_llm", F.col("manager_llm") != "")
        self.emit(led, me, ("hasAgentMember", boss))
        self.config(t, F.col("verbose"), me, F.concat(F.lit("Team_"), F.col("team_key")), "hasSystemConfig", "verbose", F.lit("true"))
        self.memory(t, F.col("memory"), me, "team_key", "GroupShared", "hasTeamMemoryBinding", F.lit("Persistent"))
        self.knowledge(t, me)

    def coordination(self, rows: DataFrame, me: Column, pattern: Column) -> None:
        node = T.iri_of(self.v.extension, pattern)
        self.emit(rows, me, ("employsCoordinationPattern", node))
        self.emit(rows, node, kind="CoordinationPattern")

    def terminations(self, t: DataFrame, me: Column) -> None:
        each = t.select("system_id", "ns", "team_key", F.posexplode("termination_conditions").alias("i", "c")).withColumn("at", F.concat_ws("_", "team_key", F.col("i").cast("string")))
        for kind, (prefix, cls) in TERMINATION.items():
            facts = {"EventBased": [("hasTriggerExpression", text("c.trigger"))], "TurnLimit": [("hasMaxTurns", number("c.max_turns"))], "Routing": [], "Composite": [("hasOperator", text(F.coalesce("c.operator", F.lit("OR"))))]}[kind]
            self.emit(each, self.node(prefix, "at"), *facts, kind=cls, where=F.col("c.type") == kind)
            self.emit(each, me, ("hasTerminationCondition", self.node(prefix, "at")), where=F.col("c.type") == kind)
        inner = each.where("c.type = 'Composite'").select("system_id", "ns", F.col("at").alias("whole"), F.posexplode("c.conditions").alias("j", "c")).withColumn("at", F.concat(F.col("whole"), F.lit("_sub"), F.col("j").cast("string")))
        for kind, fact in (("EventBased", ("hasTriggerExpression", text("c.trigger"))), ("TurnLimit", ("hasMaxTurns", number("c.max_turns")))):
            prefix, cls = TERMINATION[kind]
            self.emit(inner, self.node(prefix, "at"), fact, kind=cls, where=F.col("c.type") == kind)
            self.emit(inner, self.node("CompositeTermination", "whole"), ("hasSubCondition", self.node(prefix, "at")), where=F.col("c.type") == kind)
        same = F.exists(F.coalesce("termination_conditions", F.expr("cast(array() as array<struct<type:string,trigger:string,max_turns:int,operator:string,conditions:array<struct<type:string,trigger:string,max_turns:int>>>>)")), lambda c: (c["type"] == "TurnLimit") & (c["max_turns"] == F.col("max_turns")))
        limited = F.col("max_turns").isNotNull() & ~F.coalesce(same, F.lit(False))
        self.emit(t, self.node("TurnLimit", "team_key"), ("hasMaxTurns", number("max_turns")), kind="TurnLimitTermination", where=limited)
        self.emit(t, me, ("hasTerminationCondition", self.node("TurnLimit", "team_key")), where=limited)

    def steps_of_teams(self, t: DataFrame, me: Column) -> None:
        ordered = ~F.coalesce(F.col("coordination_pattern").isin(*WITHOUT_STEPS), F.lit(False)) & (F.size("task_keys") > 0)
        pattern = self.node("WorkflowPattern", "team_key")
        self.emit(t, pattern, kind="WorkflowPattern", where=ordered)
        self.emit(t, me, ("hasWorkflowPattern", pattern), where=ordered)
        steps = t.where(ordered).select("system_id", "ns", "team_key", "process", F.size("task_keys").alias("n"), F.posexplode("task_keys").alias("i", "task"))
        before = F.lag("task").over(Window.partitionBy("system_id", "team_key").orderBy("i"))
        tasks = self.r["tasks"].select("system_id", F.col("task_key").alias("task"), (F.coalesce(F.size("context_tasks"), F.lit(0)) > 0).alias("has_context")).dropDuplicates(["system_id", "task"])
        there = tasks.select("system_id", F.col("task").alias("before"), F.lit(True).alias("before_known"))
        steps = steps.withColumn("before", before).join(tasks, ["system_id", "task"], "left").join(there, ["system_id", "before"], "left")
        step = lambda key: self.node("CrewStep", "team_key", key)
        me_step = step("task")
        self.emit(steps, me_step, kind="StartStep", where=F.expr("i = 0"))
        self.emit(steps, me_step, kind="EndStep", where=F.expr("i = n - 1"))
        self.emit(steps, me_step, kind="WorkflowStep", where=F.expr("i > 0 and i < n - 1"))
        self.emit(steps, me_step, ("hasTitle", text("task")), ("stepOrder", number(F.col("i") + 1)), ("hasAssociatedTask", F.when(F.col("has_context").isNotNull(), self.node("Task", "task"))))
        self.emit(steps, pattern, ("hasWorkflowStep", me_step))
        self.emit(steps, step("before"), ("nextStep", me_step), where=F.col("before").isNotNull())
        implied = F.expr("process = 'sequential' and before is not null and has_context = false and before_known")
        self.emit(steps, self.node("Task", "task"), ("dependsOn", self.node("Task", "before")), ("hasDependencyType", text(F.lit("Sequential"))), where=implied)

    def flows(self) -> None:
        f, s = self.r["flows"], self.r["flow_steps"].withColumnRenamed("flow", "class_name")
        me, pattern = self.node("Orchestration", "class_name"), self.node("FlowWorkflowPattern", "class_name")
        branching = F.col("step_type").isin("conditional", "router")
        shape = s.groupBy("system_id", "class_name").agg(F.max(branching).alias("branches"), F.max(branching & F.coalesce(F.array_contains("return_values", F.col("method_name")), F.lit(False))).alias("loops"))
        f = f.join(shape, ["system_id", "class_name"], "left")
        self.emit(f, me, ("hasTitle", text("class_name")), ("hasWorkflowPattern", pattern), kind="Orchestration")
        self.emit(f, pattern, kind="WorkflowPattern")
        self.coordination(f, me, F.when(~F.coalesce("branches", F.lit(False)), "Sequential").when(F.col("loops"), "ReActLoop").otherwise("Hierarchical"))
        state = F.size("state_fields") > 0
        self.emit(f, me, ("hasOutputSchema", self.node("StateSchema", "class_name")), where=state)
        keys = F.array_sort(F.map_keys("state_fields"))
        definition = json_of("state_fields", keys)
        self.emit(f, self.node("StateSchema", "class_name"), ("hasSchemaDefinition", text(definition)), ("hasTitle", text("state_model")), ("hasSourceAttribute", text(F.lit("state_model"))), kind="Schema", where=state)
        led = f.withColumn("team", F.explode("crew_references")).join(self.known("teams", "team_key", "team"), ["system_id", "team"], "left_semi")
        self.emit(led, me, ("orchestratesTeam", self.node("Team", "team")))
        step = self.node("FlowStep", "method_name")
        body = F.coalesce("function_body", F.lit(""))
        own_body = (body != "") & ~body.startswith("routing_function:")
        conditional = branching | own_body
        names = s.select("system_id", "class_name", F.col("method_name").alias("label")).distinct()
        labels = s.withColumn("label", F.explode("dependencies")).where("label <> ''").join(names, ["system_id", "class_name", "label"], "left_anti")
        self.emit(labels, step, ("hasDecoratorArgument", text("label")))
        keyed = s.select(F.concat_ws("\x1f", "system_id", "class_name").alias("flow"), F.col("method_name").alias("name"), F.coalesce("dependencies", F.array().cast("array<string>")).alias("dependencies"), "return_values", "outgoing")
        edges = checkpointed(resolved_edges(keyed).join(s.select(F.concat_ws("\x1f", "system_id", "class_name").alias("flow"), "system_id", "ns").distinct(), "flow"))
        self.emit(edges, self.node("FlowStep", "src"), ("nextStep", self.node("FlowStep", "dst")))
        leading = edges.select("system_id", F.col("src").alias("method_name")).distinct().withColumn("leads", F.lit(True))
        agents = self.known("agents", "agent_key", "associated_agent_key").withColumn("known", F.lit(True))
        s = s.join(agents, ["system_id", "associated_agent_key"], "left").join(leading, ["system_id", "method_name"], "left")
        self.emit(s, step, ("hasTitle", text("method_name")), ("stepOrder", number(F.col("ord") + 1)), ("callsCrew", text("calls_crew")), ("hasAggregationCombinator", text("aggregation_combinator")), ("hasRoutingLogic", text(F.when(own_body | ((F.col("step_type") == "router") & (body != "")), body))), kind="WorkflowStep")
        self.emit(s, pattern, ("hasWorkflowStep", step))
        self.emit(s, step, kind="StartStep", where=F.col("step_type") == "start")
        self.emit(s, step, kind="ConditionalStep", where=conditional)
        edge_keys = F.array_sort(F.map_keys("edge_mapping"))
        self.emit(s, step, ("hasEdgeMapping", text(json_of("edge_mapping", edge_keys))), where=F.size("edge_mapping") > 0)
        self.emit(s, step, ("hasAssociatedAgent", self.node("Agent", "associated_agent_key")), where=F.col("known"))
        self.emit(s, step, kind="EndStep", where=~conditional & (F.col("step_type") != "start") & F.col("leads").isNull())

    def systems(self) -> None:
        s = self.r["systems"]
        me = self.node_of_system()
        self.emit(s, me, ("hasTitle", text("name")), ("hasSourceFramework", text("framework")), kind="AgenticSystem")
        of = s.select("system_id", "name")  # a system's members are read once a kind
        for kind, key, prefix, holds in (("teams", "team_key", "Team", "containsTeam"), ("agents", "agent_key", "Agent", "containsAgent"), ("flows", "class_name", "Orchestration", "containsOrchestration")):
            self.emit(self.r[kind].select("system_id", "ns", key).join(of, "system_id"), me, (holds, self.node(prefix, key)))
        self.emit(self.managers.join(of, "system_id"), me, ("containsAgent", self.node("Agent", "manager")))

    def node_of_system(self) -> Column:
        return T.iri_of(F.col("ns"), T.safe_id(F.col("name")))

    def run(self) -> DataFrame:
        for rule in (self.tools, self.agents, self.tasks, self.teams, self.flows, self.systems):
            rule()
        parts = [rows.select(F.col("system_id").alias("graph_id"), F.inline(F.array(*facts))) for rows, facts in self.told.values()]
        return reduce(DataFrame.unionByName, [p.where("s is not null and o is not null") for p in parts]).dropDuplicates(["graph_id", "s", "p", "o"])


def lifted(spark: SparkSession, records: dict[str, DataFrame], vocabulary: Vocabulary | None = None) -> DataFrame:
    """Triples (graph_id = system_id) of records; kinds that are left out are empty."""
    return Lift(spark, records, vocabulary or Vocabulary()).run()
