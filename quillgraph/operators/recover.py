"""Agents, tasks and teams that no single file states: state graphs and group chats put together from symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import terms as T
from .symbols import VALUE, Symbols, symbol
from .workflow import topology

FUNCTION = "doc string, model array<array<string>>, prompt array<array<string>>, human array<array<string>>, asks boolean, invoked array<string>, keys array<string>, plain boolean, tool_node boolean, handler boolean, dynamic boolean, targets array<string>, says array<string>, body string, schema string, public boolean"
#: What a node tells of its function; bodies and schemas stay where they are.
ASKED = ("doc", "model", "prompt", "human", "asks", "invoked", "keys", "plain", "tool_node", "handler", "dynamic")
#: How long the memories of agents last, from the shortest, and models that reason by themselves.
PERSISTENCE = ("ExecutionScoped", "ThreadScoped", "Persistent")
MEMORIES = {"ListMemory": "ExecutionScoped", "ChromaDBVectorMemory": "Persistent", "RedisMemory": "Persistent"}
REASONERS = ("o1", "o1-mini", "o1-preview", "o3", "o3-mini", "o3-pro")


def _none() -> Column:
    return F.array().cast("array<string>")


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def _reference() -> Column:
    """module.function of a function's row."""
    return F.concat_ws(".", F.regexp_replace(F.substring_index("path", "/", -1), r"\.py$", ""), "name")


class Recovery:
    def __init__(self, found: DataFrame):
        self.s = Symbols(found)
        # both are asked for many things, each of which reads its own columns and parses no payload again
        self.functions = self.s.kept(self.s.of("function", FUNCTION).drop("payload").withColumn("dst", symbol("path", "name")))
        self.values = self.s.kept(self.s.of("value", VALUE + ", model array<array<string>>, prompt array<array<string>>, about array<array<string>>").drop("payload").withColumn("dst", symbol("path", "name")))
        self.models = self.s.dealt(self._models())
        self.tools = self.s.dealt(self._tools())

    def _models(self) -> DataFrame:
        """system_id, src, model: the model that a symbol's value is made with (the first one by place of definition)."""
        ids = self.values.where("size(model) > 0").select("system_id", F.col("dst").alias("id"), "path", "model", "ord")
        told = self.s.texts(ids.withColumnRenamed("model", "said")).select("system_id", F.col("id").alias("dst"), "text")
        told = told.join(ids.select("system_id", F.col("id").alias("dst"), "path", "ord"), ["system_id", "dst"])
        self.own_models = self.s.kept(told)
        near = self.s.made_of.join(self.own_models, ["system_id", "dst"])
        return near.groupBy("system_id", "src").agg(F.min_by("text", F.struct((F.col("src") != F.col("dst")).alias("far"), "path", "ord")).alias("model"))

    def tool_names(self, rows: DataFrame) -> DataFrame:
        """rows (system_id, id, path, k, tool) with `tool` as the name of the function or class that it means."""
        meant = self.s.means.join(self.functions.select("system_id", "dst", F.col("name").alias("meant")), ["system_id", "dst"])
        wrapped = self.s.means.join(self.values.where("wraps <> ''").select("system_id", "dst", symbol("path", "wraps").alias("inner")), ["system_id", "dst"])
        through = wrapped.select("system_id", "src", F.col("inner")).join(self.s.dealt(meant.select("system_id", F.col("src").alias("inner"), "meant")), ["system_id", "inner"], "left")
        through = through.select("system_id", "src", F.coalesce("meant", F.element_at(F.split("inner", "[\x1f.]"), -1)).alias("meant"))
        known = meant.select("system_id", "src", "meant").union(through).groupBy("system_id", "src").agg(F.min("meant").alias("meant"))
        last = F.element_at(F.split("tool", r"\."), -1)
        met = rows.withColumn("src", symbol("path", "tool")).join(self.s.dealt(known), ["system_id", "src"], "left")
        return met.select("system_id", "id", "k", F.coalesce("meant", last).alias("tool"))

    def listed(self, rows: DataFrame) -> DataFrame:
        """system_id, id, tools of rows (system_id, id, path, tools, tools_of): lists as they stand, or under a name."""
        there = rows.select("system_id", "id", "path", F.posexplode("tools").alias("k", "tool"))
        lists = self.values.where("names is not null").select("system_id", "dst", "path", "names")
        named = rows.where("tools_of <> ''").select("system_id", "id", symbol("path", "tools_of").alias("src")).join(self.s.means, ["system_id", "src"]).join(lists, ["system_id", "dst"])
        named = named.select("system_id", "id", "path", F.posexplode("names").alias("k", "tool"))
        each = self.tool_names(there.union(named))
        return each.groupBy("system_id", "id").agg(F.expr("transform(array_sort(collect_list(struct(k, tool))), x -> x.tool)").alias("tools"))

    def _tools(self) -> DataFrame:
        """system_id, src, tools: those bound to what a symbol's value is made of."""
        bound = self.values.where("tools is not null or tools_of <> ''").select("system_id", F.col("dst").alias("id"), "path", "tools", "tools_of")
        own = self.s.kept(self.listed(bound).withColumnRenamed("id", "dst"))
        self.n_bound = own.groupBy("system_id").agg(F.count(F.lit(1)).alias("n_bound"), F.first("tools").alias("only_tools"))
        return self.s.made_of.join(own, ["system_id", "dst"]).groupBy("system_id", "src").agg(F.min_by("tools", F.struct((F.col("src") != F.col("dst")).alias("far"), "dst")).alias("tools"))

    # state graphs

    def graph_of(self, rows: DataFrame) -> DataFrame:
        """rows with `graph`: the builder that the name stands for, or the name itself."""
        built = self.s.of("graph", "state string").select("system_id", symbol("path", "name").alias("dst"))
        meant = self.s.means.join(built, ["system_id", "dst"]).groupBy("system_id", "src").agg(F.min("dst").alias("graph"))
        return rows.withColumn("src", symbol("path", "name")).join(self.s.dealt(meant), ["system_id", "src"], "left").withColumn("graph", F.coalesce("graph", "src")).drop("src")

    def nodes(self) -> DataFrame:
        """One row a node of a graph, with what its target is and does."""
        rows = self.graph_of(self.s.of("node", "node string, " + VALUE)).where("node <> ''")
        one = Window.partitionBy("system_id", "graph", "node").orderBy(F.desc("path"), F.desc("ord"))
        rows = rows.withColumn("_k", F.row_number().over(one)).where("_k = 1").drop("_k")
        rows = rows.select("system_id", "graph", "node", "path", "ord", F.coalesce("tool_node", F.lit(False)).alias("is_tools"), symbol("path", F.coalesce("ref", F.lit(""))).alias("target"), symbol("path", F.coalesce("callee", F.lit(""))).alias("maker"), F.coalesce(F.col("react"), F.lit(False)).alias("inline_react"))
        function = self.s.means.join(self.functions, ["system_id", "dst"]).groupBy("system_id", "src").agg(F.min_by(F.struct("path", *ASKED, F.col("name").alias("function")), F.struct((F.col("src") != F.col("dst")).alias("far"), "dst")).alias("f"))
        function = self.s.kept(function)
        value = self.s.means.join(self.values, ["system_id", "dst"]).groupBy("system_id", "src").agg(F.min_by(F.struct("path", "callee", "tool_node", "react"), F.struct((F.col("src") != F.col("dst")).alias("far"), "dst", "ord")).alias("v"))
        met = rows.join(function.withColumnRenamed("src", "target"), ["system_id", "target"], "left").join(self.s.dealt(value).withColumnRenamed("src", "target"), ["system_id", "target"], "left")
        met = met.withColumn("maker", F.when(F.col("v.callee") != "", symbol(F.col("v.path"), F.col("v.callee"))).otherwise(F.col("maker")))
        made = function.select("system_id", F.col("src").alias("maker"), F.col("f.tool_node").alias("m_tools"), F.col("f.handler").alias("m_handler"), F.col("f.dynamic").alias("m_dynamic"))
        met = met.join(made, ["system_id", "maker"], "left")
        yes = lambda c: F.coalesce(F.col(c), F.lit(False))
        return self.s.kept(met.select(
            "system_id", "graph", "node", "path", "ord", "target", "f",
            (yes("is_tools") | yes("v.tool_node") | yes("m_tools")).alias("is_tools"), yes("m_dynamic").alias("dynamic"), (yes("m_handler") & ~yes("m_dynamic")).alias("handler"),
            (yes("v.react") | yes("inline_react")).alias("is_react"),
        ))

    def state_graphs(self) -> dict[str, DataFrame]:
        """agents, tasks, teams, nodes, edges and memories of state graphs."""
        s, nodes = self.s, self.nodes()
        # what a node's function asks, in order; a node may also be an agent value itself
        asked = nodes.where("f is not null").select("system_id", "graph", "node", F.col("f.path").alias("of"), F.posexplode("f.invoked").alias("k", "name")).withColumn("src", symbol("of", "name"))
        asked = asked.select("system_id", "graph", "node", "k", "src").union(nodes.where("is_react").select("system_id", "graph", "node", F.lit(0), "target"))
        react = s.means.join(self.values.where("react").select("system_id", "dst", "path", "prompt"), ["system_id", "dst"]).groupBy("system_id", "src").agg(F.min_by(F.struct("dst", "path", "prompt"), "dst").alias("react"))
        met = asked.join(self.models, ["system_id", "src"], "left").join(self.tools, ["system_id", "src"], "left").join(s.dealt(react), ["system_id", "src"], "left")
        first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("k"))).alias(c)
        brains = met.groupBy("system_id", "graph", "node").agg(first("model"), first("tools"), F.min_by("react", F.when(F.col("react").isNotNull(), F.col("k"))).alias("react"), F.count(F.lit(1)).alias("n_asked"))
        module = self.own_models.where("not contains(split_part(dst, '\x1f', 2), '.') and not endswith(dst, '()')")
        whole = module.groupBy("system_id").agg(F.min_by("text", F.struct("path", "ord")).alias("any_model"), F.count(F.lit(1)).alias("n_models"))
        rows = nodes.join(s.dealt(brains), ["system_id", "graph", "node"], "left").join(whole, "system_id", "left").join(self.n_bound, "system_id", "left")
        rows = rows.withColumn("id", F.concat_ws("\x1f", "graph", "node"))
        said = lambda field: rows.where(F.size(F.col(f"f.{field}")) > 0).select("system_id", F.concat(F.lit(f"{field}\x1f"), "id").alias("id"), F.col("f.path").alias("path"), F.col(f"f.{field}").alias("said"))
        reacts = rows.where("size(react.prompt) > 0").select("system_id", F.concat(F.lit("react\x1f"), "id").alias("id"), F.col("react.path").alias("path"), F.col("react.prompt").alias("said"))
        told = self.s.kept(s.texts(said("model").union(said("prompt")).union(said("human")).union(reacts)))
        for field in ("model", "prompt", "human", "react"):
            one = told.where(F.col("id").startswith(f"{field}\x1f")).select("system_id", F.substring_index("id", "\x1f", -3).alias("id"), F.col("text").alias(f"{field}_text"))
            rows = rows.join(one, ["system_id", "id"], "left")
        no = F.lit(False)
        has_tools, is_react = F.size(F.coalesce("tools", _none())) > 0, F.col("react").isNotNull()
        plain = F.coalesce("f.plain", no) & F.col("model_text").isNull() & F.col("model").isNull() & ~is_react & ~has_tools
        rows = rows.withColumn("kind", F.when(F.col("is_tools"), "tool").when(F.col("handler") | plain, "other").otherwise("agent"))
        known = F.coalesce(F.when(is_react, F.col("model")), F.col("model_text"), F.col("model"), F.when(F.col("f").isNotNull() | (F.col("n_models") == 1), F.col("any_model")))
        alone = F.when((F.col("n_bound") == 1) & F.col("n_asked").isNull() & F.col("f").isNotNull(), F.array_sort("only_tools"))
        rows = rows.withColumn("llm", known).withColumn("uses", F.coalesce(F.when(is_react, F.col("tools")), F.when(has_tools, F.array_sort("tools")), alone, _none()))
        stops = self._stops()
        rows = rows.join(s.dealt(stops), ["system_id", "graph", "node"], "left").withColumn("key", T.safe_id(F.col("node")))
        rows = self.s.kept(rows.withColumn("is_react", is_react))
        a = rows.where("kind = 'agent'")
        key = Window.partitionBy("system_id", "key").orderBy("path", "ord")
        a = a.withColumn("_k", F.row_number().over(key)).where("_k = 1")
        fn = F.col("f").isNotNull() | F.col("is_react")
        agents = a.select(
            "system_id", F.col("key").alias("agent_key"), F.col("node").alias("role"), F.coalesce("f.doc", F.lit("")).alias("goal"), F.coalesce("prompt_text", "react_text", F.lit("")).alias("backstory"),
            "llm", F.col("uses").alias("tools"), F.col("is_react").alias("reasoning"), F.when(F.col("is_react"), "FrameworkManaged").alias("reasoning_origin"), F.when(F.col("is_react"), "ReAct").alias("reasoning_pattern"),
            no.alias("memory"), F.when(fn, "ModelDirective").alias("directive_function"), F.when(fn, "system_prompt").alias("prompt_source"), (F.coalesce("f.asks", no) | F.coalesce("stops", no)).alias("human_input"), F.col("path").alias("source_file"),
        )
        bare = F.col("human_text") == F.expr("IF(size(f.human) = 1 AND f.human[0][0] = 'n', f.human[0][2], NULL)")
        described = F.when(F.coalesce(bare, no), F.trim("f.doc")).otherwise(F.col("human_text"))
        described = F.coalesce(F.nullif(described, F.lit("")), F.concat(F.lit("Perform "), "node", F.lit(" responsibilities")))
        tasks = a.select("system_id", F.concat(F.lit("task_"), "key").alias("task_key"), described.alias("description"), F.array_join(F.coalesce("f.keys", _none()), ",").alias("expected_output"), F.col("key").alias("agent_key"), F.lit("TopologyDetermined").alias("delegation_strategy"), F.col("path").alias("source_file"))
        edges = self._edges()
        return {"agents": agents, "tasks": tasks, "teams": self._teams(rows, edges), "nodes": rows, "edges": edges, "memories": self.memories()}

    def _stops(self) -> DataFrame:
        """system_id, graph, node, stops: nodes before or after which a compiled graph asks."""
        made = self.graph_of(self.s.of("compile", "interrupt_before array<string>, interrupt_after array<string>"))
        each = made.select("system_id", "graph", F.explode(F.array_union(F.coalesce("interrupt_before", _none()), F.coalesce("interrupt_after", _none()))).alias("node"))
        return each.distinct().withColumn("stops", F.lit(True))

    def memories(self) -> DataFrame:
        """system_id, graph, type, persistence: of all that a graph is compiled with, what lasts longest."""
        made = self.graph_of(self.s.of("compile", "checkpointer string, store string"))
        each = made.select("system_id", "graph", F.inline(F.array(F.struct(F.col("checkpointer").alias("type"), F.lit(1).alias("lasts")), F.struct(F.col("store").alias("type"), F.lit(2).alias("lasts"))))).where("type is not null")
        lasts = F.element_at(F.array(*map(F.lit, PERSISTENCE)), F.max("lasts") + 1)
        return each.groupBy("system_id", "graph").agg(F.min_by("type", F.struct(-F.col("lasts"), "type")).alias("type"), lasts.alias("persistence"))

    def _edges(self) -> DataFrame:
        """system_id, graph, src, dst, conditional. A fan without a mapping leads where its router may lead."""
        plain = self.graph_of(self.s.of("edge", "src string, dst string").withColumnRenamed("src", "from")).select("system_id", "graph", F.col("from").alias("src"), "dst", F.lit(False).alias("conditional"))
        fans = self.graph_of(self.s.of("fan", "src string, router string, targets array<string>").withColumnRenamed("src", "from"))
        routers = self.s.means.join(self.functions, ["system_id", "dst"]).groupBy("system_id", "src").agg(F.min_by(F.when(F.size("targets") > 0, F.col("targets")).otherwise(F.array_distinct("says")), F.struct((F.col("src") != F.col("dst")).alias("far"), "dst")).alias("leads"))
        met = fans.withColumn("src", symbol("path", "router")).join(self.s.dealt(routers), ["system_id", "src"], "left")
        targets = F.when(F.size("targets") > 0, F.col("targets")).otherwise(F.coalesce("leads", _none()))
        out = met.select("system_id", "graph", F.col("from").alias("src"), F.explode_outer(targets).alias("dst"), F.lit(True).alias("conditional"))
        return self.s.kept(plain.union(out).distinct())

    def _teams(self, rows: DataFrame, edges: DataFrame) -> DataFrame:
        flow = F.concat_ws("\x1e", "system_id", "graph").alias("flow")
        # a supervisor decides where to go when it runs
        pattern = topology(rows.select(flow, F.col("node").alias("name"), "kind", "dynamic"), edges.select(flow, "src", "dst", "conditional"))
        order = F.struct("path", "ord", "graph")
        members = rows.groupBy("system_id", "graph").agg(F.min(order).alias("at"), F.expr("transform(array_sort(collect_list(IF(kind = 'agent', struct(ord, key), NULL))), x -> x.key)").alias("keys"))
        number = F.row_number().over(Window.partitionBy("system_id").orderBy("at")) - 1
        teams = members.withColumn("n", number).withColumn("flow", flow).join(pattern, "flow", "left").join(self.memories().select("system_id", "graph", F.lit(True).alias("remembers")), ["system_id", "graph"], "left")
        end = F.from_json(F.lit('[{"type": "Routing"}]'), "array<struct<type:string,trigger:string,max_turns:int,operator:string,conditions:array<struct<type:string,trigger:string,max_turns:int>>>>")
        return teams.select("system_id", F.concat(F.lit("langgraph_team_"), F.col("n").cast("string")).alias("team_key"), F.lit("StateGraph").alias("team_class_name"), F.col("keys").alias("agent_keys"), F.transform("keys", lambda k: F.concat(F.lit("task_"), k)).alias("task_keys"), F.lit("sequential").alias("process"), F.coalesce("remembers", F.lit(False)).alias("memory"), F.col("pattern").alias("coordination_pattern"), end.alias("termination_conditions"), F.col("at.path").alias("source_file"))

    def routings(self) -> DataFrame:
        """system_id, node, body: the code that decides where a node leads."""
        fans = self.s.of("fan", "src string, router string").select("system_id", F.col("src").alias("node"), symbol("path", "router").alias("src"))
        bodies = self.s.means.join(self.functions.select("system_id", "dst", "body"), ["system_id", "dst"]).groupBy("system_id", "src").agg(F.min_by("body", F.struct((F.col("src") != F.col("dst")).alias("far"), "dst")).alias("body"))
        return fans.join(bodies, ["system_id", "src"]).groupBy("system_id", "node").agg(F.min("body").alias("body"))

    def states(self) -> DataFrame:
        """system_id, state_model, state_fields of the first graph that has a state: its class's fields and those it inherits."""
        graphs = self.s.of("graph", "state string").where("state <> ''").select("system_id", "path", "ord", "state", symbol("path", "state").alias("src"))
        first = graphs.groupBy("system_id").agg(F.min_by(F.struct("src", "state"), F.struct("path", "ord")).alias("g")).select("system_id", "g.src", F.element_at(F.split("g.state", r"\."), -1).alias("state_model"))
        classes = self.s.classes.select("system_id", "dst", "fields")
        own = first.join(self.s.means, ["system_id", "src"]).join(classes.select("system_id", "dst"), ["system_id", "dst"]).select("system_id", "state_model", F.col("dst").alias("src"))
        every = own.join(self.s.ancestors(), ["system_id", "src"]).join(classes, ["system_id", "dst"]).select("system_id", "state_model", (F.col("src") == F.col("dst")).alias("own"), F.explode("fields").alias("field"))
        one = every.groupBy("system_id", "state_model", F.col("field")[0].alias("name")).agg(F.max_by(F.col("field")[1], F.struct("own", F.col("field")[1])).alias("type"))
        return one.groupBy("system_id", "state_model").agg(F.map_from_entries(F.collect_list(F.struct("name", "type"))).alias("state_fields"))

    def models_across_files(self) -> DataFrame:
        """system_id, class_name, fields, path of classes that inherit, over any files, from a model of fields."""
        roots = self.s.ancestors().withColumn("last", F.element_at(F.split("dst", "[\x1f.]"), -1)).where(F.col("last").isin("BaseModel", "TypedDict"))
        rows = self.s.classes.join(roots.select("system_id", F.col("src").alias("dst")).distinct(), ["system_id", "dst"], "left_semi")
        return rows.where(~F.col("name").endswith("Input")).select("system_id", F.col("name").alias("class_name"), "fields", "path")

    # group chats

    def chat_agents(self) -> DataFrame:
        """system_id, role, llm, tools, reasoning, memories and checkpoints of chat agents, by their names."""
        rows = self.s.of("agent", "cls string, client string, model array<array<string>>, tools array<string>, tools_of string, memories array<string>, memories_of array<string>, asks boolean, described boolean").where("name <> ''")
        one = Window.partitionBy("system_id", "name").orderBy(F.desc("path"), F.desc("ord"))
        rows = rows.withColumn("_k", F.row_number().over(one)).where("_k = 1").withColumn("id", symbol("path", F.col("ord").cast("string")))
        own = self.s.texts(rows.where("size(model) > 0").select("system_id", "id", "path", F.col("model").alias("said"))).withColumnRenamed("text", "own_model")
        known = self.models.select("system_id", F.col("src").alias("client_of"), F.col("model").alias("client_model"))
        rows = rows.join(own, ["system_id", "id"], "left").withColumn("client_of", symbol("path", "client")).join(known, ["system_id", "client_of"], "left")
        listed = self.listed(rows.select("system_id", "id", "path", "tools", "tools_of")).withColumnRenamed("tools", "uses")
        kinds = self.values.where("call is not null").select("system_id", "dst", "call")
        held = rows.select("system_id", "id", "path", F.explode("memories_of").alias("name")).withColumn("src", symbol("path", "name")).join(self.s.means, ["system_id", "src"]).join(kinds, ["system_id", "dst"]).select("system_id", "id", "call")
        held = held.union(rows.select("system_id", "id", F.explode("memories"))).withColumn("lasts", lookup(MEMORIES, F.col("call")))
        lasts = F.array_position(F.array(*map(F.lit, PERSISTENCE)), F.col("lasts"))
        held = held.groupBy("system_id", "id").agg(F.max_by("call", F.struct(lasts, "call")).alias("memory_type"), F.max_by("lasts", F.struct(lasts, "call")).alias("memory_persistence"))
        rows = rows.join(listed, ["system_id", "id"], "left").join(held, ["system_id", "id"], "left")
        llm = F.when(F.col("cls") != "UserProxyAgent", F.coalesce("client_model", "own_model"))
        native = F.exists(F.array(*map(F.lit, REASONERS)), lambda m: F.startswith(llm, m))
        return rows.select("system_id", F.col("name").alias("role"), llm.alias("llm"), F.coalesce("uses", _none()).alias("tools"), F.coalesce(native, F.lit(False)).alias("reasoning"), F.when(native, "ModelNative").alias("reasoning_origin"), (F.size("memories") + F.size("memories_of") > 0).alias("memory"), "memory_type", "memory_persistence", F.col("asks").alias("human_input"), F.lit("ModelDirective").alias("directive_function"), F.when(F.col("described"), "system_message, description").otherwise("system_message").alias("prompt_source"), F.col("path").alias("source_file"))

    def chat_tools(self) -> DataFrame:
        """Public functions as tools, described by their wrappers where they have one."""
        told = self.values.where("wraps <> '' and size(about) > 0").select("system_id", F.col("dst").alias("id"), "path", F.col("about").alias("said"))
        about = self.s.texts(told).select("system_id", "id", "text")
        wrapped = self.values.where("wraps <> ''").select("system_id", F.col("dst").alias("id"), symbol("path", "wraps").alias("src")).join(self.s.means, ["system_id", "src"]).join(about, ["system_id", "id"]).groupBy("system_id", "dst").agg(F.min("text").alias("about"))
        rows = self.functions.where("public").join(wrapped, ["system_id", "dst"], "left")
        rows = rows.select("system_id", F.col("name").alias("tool_key"), F.col("name").alias("class_name"), "name", F.coalesce(F.nullif("about", F.lit("")), "doc").alias("description"), F.col("schema").alias("args_schema_json"), _reference().alias("implementation_ref"), F.col("path").alias("source_file"))
        one = Window.partitionBy("system_id", "tool_key").orderBy("source_file")
        return rows.withColumn("_k", F.row_number().over(one)).where("_k = 1").drop("_k")

    def runs(self) -> dict[str, DataFrame]:
        """Tasks that teams and agents are run with, and the flow of those calls. A text may come through names,
        other files, and the calls of the functions that run the team."""
        rows = self.s.of("run", "method string, target string, said array<array<string>>").withColumn("id", symbol("path", F.col("ord").cast("string")))
        texts = self.s.texts(self.s.by_call(rows.where("size(said) > 0").select("system_id", "id", "path", "said"))).withColumnRenamed("id", "call")
        texts = texts.select("system_id", F.concat_ws("\x1f", F.slice(F.split("call", "\x1f"), 1, 2)).alias("id"), "call", "text")
        last = lambda c: F.element_at(F.split(c, r"\."), -1)
        caller, target = last("name"), F.nullif(last("target"), F.lit(""))
        number = F.row_number().over(Window.partitionBy("system_id").orderBy("path", "ord", "call")) - 1
        # a bare name that stays unknown says nothing
        known = rows.join(texts, ["system_id", "id"]).where("text <> '' and not (size(said) = 1 and said[0][0] = 'n' and text = said[0][2])")
        tasks = known.select("system_id", F.concat(F.lit("autogen_task_"), number.cast("string")).alias("task_key"), F.col("text").alias("description"), F.lit("").alias("expected_output"), F.lit("OrchestratorDelegated").alias("delegation_strategy"), F.lit("task").alias("source_attribute"), F.col("path").alias("source_file"))
        method = F.when(F.col("method") == "initiate_chat", F.concat(F.lit("initiate_chat_"), caller, F.lit("_to_"), F.coalesce(target, F.lit("unknown")))).otherwise(F.concat(F.lit("run_"), caller))
        steps = rows.select("system_id", "path", "ord", method.alias("method_name"), F.coalesce(target, caller).alias("calls_crew")).groupBy("system_id", "method_name", "calls_crew").agg(F.min(F.struct("path", "ord")).alias("at"))
        steps = steps.select("system_id", F.lit("AutoGenFlow").alias("flow"), (F.row_number().over(Window.partitionBy("system_id").orderBy("at", "method_name")) - 1).alias("ord"), "method_name", F.lit("start").alias("step_type"), "calls_crew")
        flows = rows.groupBy("system_id").agg(F.min("path").alias("source_file")).withColumn("class_name", F.lit("AutoGenFlow"))
        return {"tasks": tasks, "flow_steps": steps, "flows": flows}


def extracted(files: DataFrame, framework: str, namespace: str = "http://example.org/", entries: DataFrame | None = None, strict: bool = False) -> dict[str, DataFrame]:
    """Records for lifting out of the sources of systems (system_id, path, source) of one framework.

    What single files state comes from extract.program_records; what only several places together tell
    (models, tools, prompts, memories and checkpoints of state graphs and chat agents, tasks out of run
    calls) is recovered along symbols. framework is the label that systems get: one that begins with
    LangGraph has state graphs, one that begins with AutoGen has chats, others have neither."""
    from .extract import program_records, to_records
    from .symbols import kept_facts

    records = to_records(program_records(files, strict), framework, namespace, entries)
    if framework.startswith("LangGraph"):
        return _with_graphs(records, Recovery(kept_facts(files, strict)))
    if framework.startswith("AutoGen"):
        return _with_chats(records, Recovery(kept_facts(files, strict)))
    return records


def _with_graphs(records: dict[str, DataFrame], recovery: Recovery) -> dict[str, DataFrame]:
    made = recovery.state_graphs()
    agents, key = made["agents"], ["system_id", "agent_key"]
    steps = records["flow_steps"].join(agents.select("system_id", F.col("role").alias("method_name"), F.col("agent_key").alias("_agent")), ["system_id", "method_name"], "left")
    steps = steps.withColumn("associated_agent_key", F.col("_agent")).drop("_agent")
    graph_nodes = made["nodes"].select("system_id", F.col("node").alias("agent_key")).union(made["nodes"].select("system_id", "key")).distinct()
    steps = steps.join(recovery.routings().withColumnRenamed("node", "method_name"), ["system_id", "method_name"], "left")
    steps = steps.withColumn("function_body", F.coalesce("body", F.when(F.col("function_body") != "", F.concat(F.lit("routing_function: "), "function_body")))).drop("body")
    flows = records["flows"].join(recovery.states().withColumnsRenamed({"state_model": "_model", "state_fields": "_fields"}), "system_id", "left")
    flows = flows.withColumn("state_model", F.coalesce("state_model", "_model")).withColumn("state_fields", F.coalesce("state_fields", "_fields")).drop("_model", "_fields")
    others = records["agents"].join(graph_nodes, key, "left_anti")
    schemas = recovery.functions.select("system_id", F.col("name").alias("tool_key"), F.col("schema").alias("args_schema_json"), _reference().alias("_reference")).dropDuplicates(["system_id", "tool_key"])
    tools = records["tools"].join(schemas, ["system_id", "tool_key"], "left")
    tools = tools.withColumn("implementation_ref", F.coalesce("_reference", "implementation_ref")).drop("_reference")
    return records | {
        "agents": others.unionByName(agents, allowMissingColumns=True), "tasks": records["tasks"].unionByName(made["tasks"], allowMissingColumns=True),
        "teams": records["teams"].unionByName(made["teams"], allowMissingColumns=True), "flow_steps": steps, "flows": flows, "tools": tools,
    }


def _with_chats(records: dict[str, DataFrame], recovery: Recovery) -> dict[str, DataFrame]:
    known, runs = recovery.chat_agents(), recovery.runs()
    told = [c for c in known.columns if c not in ("system_id", "role")]
    agents = records["agents"].drop("reasoning_origin", "memory_type")
    met = agents.select(*[F.col(c) for c in agents.columns if c not in told], *[F.col(c).alias(f"_{c}") for c in agents.columns if c in told]).join(known, ["system_id", "role"], "left")
    filled = [F.coalesce(c, f"_{c}").alias(c) if c in agents.columns else F.col(c) for c in told]
    agents = met.select(*[c for c in agents.columns if c not in told], *filled)
    # of several teams of a class, each has its number in the key
    number = F.row_number().over(Window.partitionBy("system_id").orderBy("ord")) - 1
    teams = records["teams"].withColumn("team_key", F.concat_ws("_", "team_class_name", number.cast("string"))).drop("ord")
    return records | {
        "teams": teams, "agents": agents, "tools": recovery.chat_tools(), "tasks": records["tasks"].unionByName(runs["tasks"], allowMissingColumns=True),
        "flows": records["flows"].unionByName(runs["flows"], allowMissingColumns=True), "flow_steps": records["flow_steps"].unionByName(runs["flow_steps"], allowMissingColumns=True),
    }
