"""Triples to records: the way back from lift.

Single-valued properties are read in one aggregation over the graph (the least value where there are
several); what is further away is a join. Forward references resolve, since keys come from joins with
all individuals and not from those seen so far. Not in triples, and so null in records: an agent's
description and human_input, whether a tool is external, source files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import terms as T
from ..plans.catalog import Vocabulary
from .closure import checkpointed

#: Properties with one text or number a subject (fixed values of the vocabulary).
VALUES = (
    "hasTitle hasDescription hasInputSchema hasImplementationReference hasReference agentID agentRole agentType hasReasoningEnabled hasReasoningOrigin hasMaxReasoningAttempts hasExpectedOutput hasDelegationStrategy"
    " promptInstruction promptContext promptOutputIndicator hasDirectiveFunction hasSourceAttribute configKey configValue hasPersistenceScope hasSourceFramework hasSchemaDefinition hasGuardrailType hasValidationLogic"
    " hasMaxRetries hasTriggerExpression hasMaxTurns hasOperator stepOrder callsCrew hasAggregationCombinator hasRoutingLogic hasEdgeMapping hasCheckpointType"
).split()
#: Of kinds that take values by outer joins only, all that they take: a node without one is there either way.
OWN_VALUES = {
    "systems": ("hasTitle", "hasSourceFramework"),
    "tools": ("hasTitle", "hasDescription", "hasInputSchema", "hasImplementationReference"),
    "flows": ("hasTitle", "hasSchemaDefinition"),
    "models": ("hasTitle", "hasSchemaDefinition"),
}
KINDS = ("systems", "agents", "tasks", "tools", "teams", "flows", "flow_steps", "models")


class Lower:
    def __init__(self, triples: DataFrame, vocabulary: Vocabulary, kinds: tuple[str, ...] = KINDS, kept: bool = False):
        rows = triples.select(F.col("graph_id").alias("system_id"), "s", "p", "o")
        self.t, self.v = rows if kept else checkpointed(rows), vocabulary
        wanted = {n for k in kinds for n in OWN_VALUES.get(k, VALUES)}
        names = {vocabulary(n): n for n in VALUES if n in wanted}
        held = self.t.where(F.col("p").isin(*names)).groupBy("system_id", "s")
        self.wide = checkpointed(held.agg(*[T.lexical(F.min(F.when(F.col("p") == p, F.col("o")))).alias(n) for p, n in names.items()]))

    def of_class(self, *kinds: str) -> DataFrame:
        return self.t.where((F.col("p") == T.TYPE) & F.col("o").isin(*[self.v(k) for k in kinds])).select("system_id", "s").distinct()

    def told(self, who: DataFrame, *names: str) -> DataFrame:
        return who.join(self.wide.select("system_id", "s", *names), ["system_id", "s"], "left")

    def link(self, name: str, target: str) -> DataFrame:
        return self.t.where(F.col("p") == self.v(name)).select("system_id", "s", F.col("o").alias(target))

    def first(self, name: str, **values: str) -> DataFrame:
        """system_id, s and values of the node that `name` leads to (the least one)."""
        nodes = self.link(name, "_n").groupBy("system_id", "s").agg(F.min("_n").alias("_n"))
        told = self.wide.select("system_id", F.col("s").alias("_n"), *[F.col(p).alias(c) for c, p in values.items()])
        return nodes.join(told, ["system_id", "_n"], "left").drop("_n")

    def keys(self, name: str, prefix: str, column: str) -> DataFrame:
        """system_id, s and the sorted keys of the individuals that `name` leads to."""
        return self.link(name, "_n").groupBy("system_id", "s").agg(F.array_sort(F.collect_set(self.key(F.col("_n"), prefix))).alias(column))

    def titles(self, name: str, column: str) -> DataFrame:
        told = self.wide.select("system_id", F.col("s").alias("_n"), "hasTitle")
        return self.link(name, "_n").join(told, ["system_id", "_n"]).groupBy("system_id", "s").agg(F.array_sort(F.collect_set("hasTitle")).alias(column))

    @staticmethod
    def key(node: Column, prefix: str) -> Column:
        return F.regexp_replace(T.reader_name(node), f"^{prefix}_", "")

    @staticmethod
    def listed(df: DataFrame, *columns: str) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns})

    def configs(self, name: str, *keys: str) -> DataFrame:
        told = self.wide.select("system_id", F.col("s").alias("_n"), "configKey", "configValue")
        rows = self.link(name, "_n").join(told, ["system_id", "_n"])
        return rows.groupBy("system_id", "s").agg(*[F.min(F.when(F.col("configKey") == k, T.truthy(F.col("configValue")))).alias(k) for k in keys])

    def systems(self) -> DataFrame:
        s = self.told(self.of_class("AgenticSystem"), "hasTitle", "hasSourceFramework")
        one = Window.partitionBy("system_id").orderBy(F.desc("s"))
        space = F.expr("substring(s, 2, length(s) - 2 - length(regexp_extract(s, '([^/#>]*)>$', 1)))")
        return s.withColumn("_k", F.row_number().over(one)).where("_k = 1").select("system_id", F.col("hasTitle").alias("name"), F.col("hasSourceFramework").alias("framework"), space.alias("namespace"))

    def tools(self) -> DataFrame:
        only = self.of_class("Tool").join(self.of_class("LLMAgent"), ["system_id", "s"], "left_anti")
        key = self.key(F.col("s"), "Tool")
        return self.told(only, "hasTitle", "hasDescription", "hasInputSchema", "hasImplementationReference").select("system_id", key.alias("tool_key"), key.alias("class_name"), F.col("hasTitle").alias("name"), F.col("hasDescription").alias("description"), F.col("hasInputSchema").alias("args_schema_json"), F.col("hasImplementationReference").alias("implementation_ref"))

    def agents(self) -> DataFrame:
        a = self.told(self.of_class("LLMAgent"), "agentID", "agentRole", "agentType", "hasReasoningEnabled", "hasReasoningOrigin", "hasMaxReasoningAttempts")
        prompts = self.link("agentPrompt", "_n").join(self.wide.select("system_id", F.col("s").alias("_n"), "promptInstruction", "promptContext", "hasDirectiveFunction", "hasSourceAttribute"), ["system_id", "_n"])
        own = Window.partitionBy("system_id", "s").orderBy(F.coalesce(F.col("hasDirectiveFunction") == "OrchestratorDirective", F.lit(False)), "_n")
        main = prompts.withColumn("_k", F.row_number().over(own)).where("_k = 1").drop("_k", "_n")
        second = prompts.where("hasDirectiveFunction = 'OrchestratorDirective'").groupBy("system_id", "s").agg(F.min("promptInstruction").alias("description"))
        pattern = self.link("employsReasoningPattern", "_n").groupBy("system_id", "s").agg(F.min(self.key(F.col("_n"), "ReasoningPattern")).alias("reasoning_pattern"))
        memory = self.link("hasMemoryBinding", "_b").join(self.link("bindsMemory", "_m").withColumnRenamed("s", "_b"), ["system_id", "_b"]).join(self.wide.select("system_id", F.col("s").alias("_m"), F.col("hasTitle").alias("memory_type"), F.col("hasPersistenceScope").alias("memory_persistence")), ["system_id", "_m"], "left")
        memory = memory.groupBy("system_id", "s").agg(F.min("memory_type").alias("memory_type"), F.min("memory_persistence").alias("memory_persistence")).withColumn("memory", F.lit(True))
        for part in (main, second, pattern, memory, self.first("hasAgentGoal", goal="hasDescription"), self.first("useLanguageModel", llm="hasTitle"), self.keys("agentToolUsage", "Tool", "tools"), self.titles("hasKnowledge", "knowledge_sources"), self.configs("hasAgentConfig", "verbose", "allow_delegation")):
            a = a.join(part, ["system_id", "s"], "left")
        key = F.coalesce("agentID", self.key(F.col("s"), "Agent"))
        out = a.select(
            "system_id", key.alias("agent_key"), F.col("agentRole").alias("role"), F.coalesce("goal", "promptInstruction").alias("goal"), F.col("promptContext").alias("backstory"), "llm", "tools", T.truthy(F.col("hasReasoningEnabled")).alias("reasoning"),
            F.col("hasMaxReasoningAttempts").try_cast("int").alias("max_reasoning_attempts"), F.coalesce("memory", F.lit(False)).alias("memory"), "verbose", "allow_delegation", "knowledge_sources", F.col("agentType").alias("agent_type"), "description",
            F.col("hasDirectiveFunction").alias("directive_function"), F.col("hasReasoningOrigin").alias("reasoning_origin"), "reasoning_pattern", "memory_type", "memory_persistence", F.col("hasSourceAttribute").alias("prompt_source"),
        )
        return self.listed(out, "tools", "knowledge_sources")

    def tasks(self) -> DataFrame:
        t = self.told(self.of_class("Task"), "hasExpectedOutput", "hasDelegationStrategy")
        agent = self.link("performedByAgent", "_a").join(self.wide.select("system_id", F.col("s").alias("_a"), "agentID"), ["system_id", "_a"], "left").groupBy("system_id", "s").agg(F.min(F.coalesce("agentID", self.key(F.col("_a"), "Agent"))).alias("agent_key"))
        prompt = self.first("taskPrompt", description="promptInstruction", indicator="promptOutputIndicator", source_attribute="hasSourceAttribute")
        schemas = self.link("hasOutputSchema", "_n").join(self.wide.select("system_id", F.col("s").alias("_n"), "hasTitle", "hasSourceAttribute"), ["system_id", "_n"]).groupBy("system_id", "s").agg(F.min(F.when(F.col("hasSourceAttribute") == "output_pydantic", F.col("hasTitle"))).alias("output_pydantic"), F.min(F.when(F.col("hasSourceAttribute") == "output_json", F.col("hasTitle"))).alias("output_json"))
        rails = self.link("hasGuardrail", "_n").join(self.wide.select("system_id", F.col("s").alias("_n"), "hasGuardrailType", "hasValidationLogic", "hasDescription", "hasMaxRetries"), ["system_id", "_n"])
        said = F.concat(F.coalesce(F.concat("hasGuardrailType", F.lit(":")), F.lit("")), F.coalesce("hasValidationLogic", "hasDescription", F.lit("")))
        rails = rails.groupBy("system_id", "s").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", said.alias("said")))), lambda x: x["said"]).alias("guardrails"), F.max(F.col("hasMaxRetries").try_cast("int")).alias("guardrail_max_retries"))
        stop = self.link("hasHumanCheckpoint", "_n").select("system_id", "s").distinct().withColumn("human_input", F.lit(True))
        for part in (agent, prompt, schemas, rails, stop, self.keys("taskToolUsage", "Tool", "tools"), self.keys("dependsOn", "Task", "context_tasks")):
            t = t.join(part, ["system_id", "s"], "left")
        out = t.select("system_id", self.key(F.col("s"), "Task").alias("task_key"), "description", F.coalesce("hasExpectedOutput", "indicator").alias("expected_output"), "agent_key", "tools", "context_tasks", "output_pydantic", "output_json", F.coalesce("human_input", F.lit(False)).alias("human_input"), "guardrails", "guardrail_max_retries", F.col("hasDelegationStrategy").alias("delegation_strategy"), "source_attribute")
        return self.listed(out, "tools", "context_tasks", "guardrails")

    def models(self) -> DataFrame:
        s = self.told(self.of_class("Schema"), "hasTitle", "hasSchemaDefinition").where("hasSchemaDefinition is not null and hasTitle is not null")
        return s.groupBy("system_id", F.col("hasTitle").alias("class_name")).agg(F.min("hasSchemaDefinition").alias("schema_json"))

    def teams(self) -> DataFrame:
        t = self.told(self.of_class("Team"), "hasTitle")
        agents = self.link("hasAgentMember", "_a").join(self.wide.select("system_id", F.col("s").alias("_a"), "agentID"), ["system_id", "_a"], "left").groupBy("system_id", "s").agg(F.array_sort(F.collect_set(F.coalesce("agentID", self.key(F.col("_a"), "Agent")))).alias("agent_keys"))
        pattern = self.link("employsCoordinationPattern", "_p").groupBy("system_id", "s").agg(F.min(T.reader_name(F.col("_p"))).alias("coordination_pattern"))
        steps = self.link("hasWorkflowPattern", "_w").join(self.link("hasWorkflowStep", "_s").withColumnRenamed("s", "_w"), ["system_id", "_w"]).join(self.wide.select("system_id", F.col("s").alias("_s"), "stepOrder"), ["system_id", "_s"], "left").join(self.link("hasAssociatedTask", "_t").withColumnRenamed("s", "_s"), ["system_id", "_s"])
        rank = F.coalesce(F.col("stepOrder").try_cast("int"), F.lit(0)).alias("k")
        steps = steps.groupBy("system_id", "s").agg(F.transform(F.array_sort(F.collect_list(F.struct(rank, "_s", self.key(F.col("_t"), "Task").alias("task")))), lambda x: x["task"]).alias("task_keys"))
        ends, limit = self.terminations()
        memory = self.link("hasTeamMemoryBinding", "_m").select("system_id", "s").distinct().withColumn("memory", F.lit(True))
        for part in (agents, pattern, steps, ends, limit, memory, self.titles("hasKnowledge", "knowledge_sources"), self.configs("hasSystemConfig", "verbose")):
            t = t.join(part, ["system_id", "s"], "left")
        process = F.when(F.lower("coordination_pattern").startswith("hierarch"), "hierarchical").otherwise("sequential")
        out = t.select("system_id", self.key(F.col("s"), "Team").alias("team_key"), F.coalesce("hasTitle", self.key(F.col("s"), "Team")).alias("team_class_name"), "agent_keys", "task_keys", process.alias("process"), F.coalesce("verbose", F.lit(False)).alias("verbose"), F.coalesce("memory", F.lit(False)).alias("memory"), "max_turns", "knowledge_sources", "coordination_pattern", "termination_conditions")
        return self.listed(out, "agent_keys", "task_keys", "knowledge_sources")

    def terminations(self) -> tuple[DataFrame, DataFrame]:
        """Conditions of teams, composites with their parts; and the turn limit, of a composite's parts too."""
        kinds = {self.v(k): n for n, k in (("EventBased", "EventBasedTermination"), ("TurnLimit", "TurnLimitTermination"), ("Routing", "RoutingTermination"), ("Composite", "CompositeTermination"))}
        of = self.t.where((F.col("p") == T.TYPE) & F.col("o").isin(*kinds))
        name = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
        told = of.select("system_id", F.col("s").alias("_c"), F.element_at(name, F.col("o")).alias("type")).join(self.wide.select("system_id", F.col("s").alias("_c"), F.col("hasTriggerExpression").alias("trigger"), F.col("hasMaxTurns").try_cast("int").alias("max_turns"), F.col("hasOperator").alias("operator")), ["system_id", "_c"], "left")
        inner = self.link("hasSubCondition", "_sub").join(told.select("system_id", F.col("_c").alias("_sub"), "type", "trigger", "max_turns"), ["system_id", "_sub"])
        parts = inner.groupBy("system_id", F.col("s").alias("_c")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_sub", "type", "trigger", "max_turns"))), lambda x: F.struct(x["type"].alias("type"), x["trigger"].alias("trigger"), x["max_turns"].alias("max_turns"))).alias("conditions"), F.min("max_turns").alias("_inner"))
        rows = self.link("hasTerminationCondition", "_c").join(told, ["system_id", "_c"]).join(parts, ["system_id", "_c"], "left")
        sorted_rows = F.array_sort(F.collect_list(F.struct("_c", "type", "trigger", "max_turns", "operator", "conditions")))
        plain = F.transform(sorted_rows, lambda x: F.struct(*[x[c].alias(c) for c in ("type", "trigger", "max_turns", "operator", "conditions")]))
        return rows.groupBy("system_id", "s").agg(plain.alias("termination_conditions")), rows.groupBy("system_id", "s").agg(F.min(F.coalesce("max_turns", "_inner")).alias("max_turns"))

    def flows(self) -> DataFrame:
        f = self.told(self.of_class("Orchestration"), "hasTitle")
        one = Window.partitionBy("system_id").orderBy(F.desc("s"))
        f = f.withColumn("_k", F.row_number().over(one)).where("_k = 1").drop("_k")
        state = self.first("hasOutputSchema", state_model="hasTitle", definition="hasSchemaDefinition")
        f = f.join(state, ["system_id", "s"], "left").join(self.keys("orchestratesTeam", "Team", "crew_references"), ["system_id", "s"], "left")
        out = f.select("system_id", F.coalesce("hasTitle", self.key(F.col("s"), "Orchestration")).alias("class_name"), "state_model", "crew_references", F.from_json("definition", "map<string,string>").alias("state_fields"))
        return self.listed(out, "crew_references")

    def flow_steps(self) -> DataFrame:
        owner = self.link("hasWorkflowPattern", "_w").join(self.of_class("Orchestration"), ["system_id", "s"], "left_semi")
        own = owner.join(self.link("hasWorkflowStep", "_s").withColumnRenamed("s", "_w"), ["system_id", "_w"]).select("system_id", F.col("s").alias("_o"), F.col("_s").alias("s")).distinct()
        flow = self.wide.select("system_id", F.col("s").alias("_o"), F.col("hasTitle").alias("flow"))
        s = self.told(own.join(flow, ["system_id", "_o"], "left"), "hasTitle", "stepOrder", "callsCrew", "hasAggregationCombinator", "hasRoutingLogic", "hasEdgeMapping")
        is_a = lambda kind, name: self.of_class(kind).withColumn(name, F.lit(True))
        for kind, name in (("ConditionalStep", "_if"), ("StartStep", "_start"), ("EndStep", "_end")):
            s = s.join(is_a(kind, name), ["system_id", "s"], "left").fillna(False, [name])
        title = self.wide.select("system_id", "s", F.col("hasTitle").alias("_name"))
        edges = self.link("nextStep", "_d").join(title.withColumnRenamed("s", "_d").withColumnRenamed("_name", "to"), ["system_id", "_d"]).join(title.withColumnRenamed("_name", "from"), ["system_id", "s"])
        leads = edges.groupBy("system_id", "s").agg(F.array_sort(F.collect_set("to")).alias("to"))
        comes = edges.groupBy("system_id", F.col("_d").alias("s")).agg(F.array_sort(F.collect_set("from")).alias("from"))
        labels = self.t.where(F.col("p") == self.v("hasDecoratorArgument")).groupBy("system_id", "s").agg(F.array_sort(F.collect_set(T.lexical(F.col("o")))).alias("labels"))
        agent = self.link("hasAssociatedAgent", "_a").groupBy("system_id", "s").agg(F.min(self.key(F.col("_a"), "Agent")).alias("associated_agent_key"))
        for part in (leads, comes, labels, agent):
            s = s.join(part, ["system_id", "s"], "left")
        s = self.listed(s, "to", "from", "labels")
        kind = F.when(F.col("_if") & ~F.col("_start"), "conditional").when(F.col("_start"), "start").when(F.col("_end"), "end").otherwise("regular")
        return s.select("system_id", "flow", (F.coalesce(F.col("stepOrder").try_cast("int"), F.lit(0)) - 1).alias("ord"), F.coalesce("hasTitle", self.key(F.col("s"), "FlowStep")).alias("method_name"), kind.alias("step_type"), F.array_union("from", "labels").alias("dependencies"), F.col("callsCrew").alias("calls_crew"), F.when(F.col("_if"), F.col("to")).otherwise(F.array().cast("array<string>")).alias("return_values"), F.col("hasRoutingLogic").alias("function_body"), "associated_agent_key", F.from_json("hasEdgeMapping", "map<string,string>").alias("edge_mapping"), F.col("hasAggregationCombinator").alias("aggregation_combinator"), F.col("to").alias("outgoing"))


def fields_of(models: DataFrame) -> DataFrame:
    """system_id, class_name, fields (name to type) of the models' JSON schemas; a property without a type is a str."""
    properties = F.from_json(F.get_json_object("schema_json", "$.properties"), "map<string,struct<type:string>>")
    return models.select("system_id", "class_name", F.transform_values(properties, lambda _, x: F.coalesce(x["type"], F.lit("str"))).alias("fields"))


def with_state(systems: DataFrame, flows: DataFrame, tasks: DataFrame) -> DataFrame:
    """The flows; one of a LangGraph system without state fields gets a str field for each task that says what it
    puts out, or else the one field shared_context."""
    made = tasks.where("coalesce(expected_output, '') <> ''").groupBy("system_id").agg(F.array_sort(F.collect_set(F.concat("task_key", F.lit("_output")))).alias("_made"))
    of = flows.join(systems.select("system_id", "framework"), "system_id", "left").join(made, "system_id", "left")
    names = F.coalesce("_made", F.array(F.lit("shared_context")))
    fields = F.map_from_arrays(names, F.transform(names, lambda _: F.lit("str")))
    missing = (F.col("framework") == "LangGraph") & (F.coalesce(F.size("state_fields"), F.lit(0)) <= 0)
    return of.withColumn("state_fields", F.when(missing, fields).otherwise(F.col("state_fields"))).select(*flows.columns)


def lowered(triples: DataFrame, vocabulary: Vocabulary | None = None, kinds: tuple[str, ...] = KINDS, kept: bool = False) -> dict[str, DataFrame]:
    """Records of all graphs (system_id = graph_id), a DataFrame for each kind asked for.

    kept: the triples are a written table, which is not written again."""
    low = Lower(triples, vocabulary or Vocabulary(), kinds, kept)
    return {n: getattr(low, n)() for n in kinds}
