"""Names across the files of a system: facts about each file, links between symbols, and what flows along them.

Files are parsed one by one (never run); all that follows is joins. A symbol is a name in a file ("path",
"name" or "function.name"). A link says that one symbol stands for another: an import, a plain assignment,
an argument that a call binds to a parameter. A flow says that a value is made out of another: a bound
model, a chain, a factory's result. Closures of links and flows are kept per system, so that a system of
many files spreads over tasks.
"""

from __future__ import annotations

import ast
import json
import posixpath
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .closure import checkpointed, dealt, transitive
from .said import Part, Scope, parts, rendered

FACT = "system_id string, path string, kind string, name string, ord int, payload string"
#: Calls that make a chat model, and names of variables that hold a system prompt.
CHAT_MODELS = ("ChatOpenAI", "ChatAnthropic", "ChatOllama", "AzureChatOpenAI", "OpenAIChatCompletionClient", "init_chat_model")
PROMPT_NAMES = ("system_message", "system_prompt", "sys_msg", "sys_prompt")
REACT_CALLS = ("create_react_agent", "create_agent")
RUN_CALLS = ("run", "run_stream", "initiate_chat")
CHAT_AGENTS = ("AssistantAgent", "UserProxyAgent")
MOST_NESTED = 8


def _called(call: ast.Call) -> str:
    return call.func.attr if isinstance(call.func, ast.Attribute) else call.func.id if isinstance(call.func, ast.Name) else ""


def _keywords(call: ast.Call) -> dict[str, ast.AST]:
    return {k.arg: k.value for k in call.keywords if k.arg}


def _names(node: ast.AST | None, scope: Scope) -> list[str]:
    return [s for e in node.elts if (s := scope.symbol(e))] if isinstance(node, (ast.List, ast.Tuple, ast.Set)) else []


def _value(node: ast.AST | None, scope: Scope) -> dict:
    """What a bound expression is: a text, a list of names, a name, or what a chain of calls makes."""
    out: dict = {}
    if node is None:
        return out
    if isinstance(node, ast.Await):
        return _value(node.value, scope)
    if isinstance(node, (ast.Name, ast.Attribute)):
        return {"ref": scope.symbol(node)} if scope.symbol(node) else out
    if isinstance(node, (ast.List, ast.Tuple, ast.Set)):
        return {"names": _names(node, scope)}
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):  # a chain of runnables
        both = [_value(node.left, scope), _value(node.right, scope)]
        return {"from": [x for v in both for x in [*v.get("from", []), *([v["ref"]] if "ref" in v else [])]], **{k: x for v in both for k, x in v.items() if k in ("model", "tools", "tools_of")}}
    said = parts(node, scope)
    if said:
        out["said"] = said
    if not isinstance(node, ast.Call):
        return out
    methods, root = [], node
    while isinstance(root.func, ast.Attribute) and isinstance(root.func.value, (ast.Call, ast.Await)):
        methods.append(root)
        root = root.func.value.value if isinstance(root.func.value, ast.Await) else root.func.value
        if not isinstance(root, ast.Call):
            break
    if isinstance(root, ast.Call) and isinstance(root.func, ast.Attribute) and scope.symbol(root.func.value):
        methods.append(root)
        out["from"] = [scope.symbol(root.func.value)]
    if isinstance(root, ast.Call):
        called, told = _called(root), _keywords(root)
        first = root.args[0] if root.args else None
        out |= {"call": called, "callee": scope.symbol(root.func)}
        if called in CHAT_MODELS:
            model = told.get("model", told.get("model_name", first if called == "init_chat_model" else None))
            out["model"] = parts(model, scope) or []
        if called in REACT_CALLS:
            model = _value(told.get("model", first), scope)
            out |= {"react": True, "from": [model["ref"]] if "ref" in model else model.get("from", [])}
            if "model" in model or "said" in model:
                out["model"] = model.get("model") or model["said"]
            out |= _tools(told.get("tools", root.args[1] if len(root.args) > 1 else None), scope)
            prompt = parts(told.get("prompt", told.get("system_prompt", told.get("state_modifier"))), scope)
            out |= {"prompt": prompt} if prompt else {}
        if called == "ToolNode":
            out["tool_node"] = True
        if called == "FunctionTool":
            out |= {"wraps": scope.symbol(first) if first is not None else "", "about": parts(told.get("description", root.args[1] if len(root.args) > 1 else None), scope)}
    for m in methods:
        if _called(m) == "bind_tools":
            out |= _tools(m.args[0] if m.args else _keywords(m).get("tools"), scope)
    return out


def _tools(node: ast.AST | None, scope: Scope) -> dict:
    if isinstance(node, (ast.Name, ast.Attribute)) and scope.symbol(node):
        return {"tools_of": scope.symbol(node)}
    return {"tools": _names(node, scope)} if node is not None else {}


def _messages(nodes: list[ast.AST], scope: Scope, roles: tuple[str, ...], call: str) -> list[tuple[str, list[Part]]]:
    """(how it stands, parts) of the messages of a role among a function's nodes: calls, dicts of role and content, pairs."""
    found = []
    for n in nodes:
        node = None
        match n:
            case ast.Call() if _called(n) == call:
                how, node = "call", _keywords(n).get("content", n.args[0] if n.args else None)
            case ast.Dict():
                told = {k.value: v for k, v in zip(n.keys, n.values, strict=True) if isinstance(k, ast.Constant)}
                if isinstance(told.get("role"), ast.Constant) and told["role"].value in roles:
                    how, node = "dict", told.get("content")
            case ast.Tuple(elts=[ast.Constant(value=str(role)), second]) if role in roles:
                how, node = "pair", second
        if node is not None:
            found.append((how, parts(node, scope) or [["h", ast.unparse(node), -1, ""]]))
    order = {"call": 0, "dict": 1, "pair": 2}
    return sorted(found, key=lambda x: order[x[0]])


def _locals(function: ast.FunctionDef | ast.AsyncFunctionDef, nodes: list[ast.AST]) -> tuple[list[str], frozenset[str]]:
    a = function.args
    given = [x.arg for x in [*a.posonlyargs, *a.args]]
    own = {*given, *(x.arg for x in a.kwonlyargs)}
    for n in nodes:
        if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
            own.add(n.id)
    return given, frozenset(own)


def _goal(node: ast.AST) -> str:
    """Where a returned value leads: a text, or the end."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return {"__end__": "END"}.get(node.value, node.value)
    return "END" if isinstance(node, (ast.Name, ast.Attribute)) and ast.unparse(node).rpartition(".")[2] == "END" else ""


def _in_order(tree: ast.AST) -> Iterator[ast.AST]:
    for n in ast.iter_child_nodes(tree):
        yield n
        yield from _in_order(n)


class _File:
    """The facts of one file, in order of place."""

    def __init__(self, path: str, tree: ast.Module):
        self.path, self.rows = path, []
        self.module(tree)

    def add(self, kind: str, name: str, **payload) -> None:
        self.rows.append((kind, name, len(self.rows), json.dumps(payload)))

    def module(self, tree: ast.Module) -> None:
        whole = self.path.removesuffix(".py").removesuffix("/__init__")
        for k in range(whole.count("/") + 1):
            self.add("module", whole.split("/", k)[-1].replace("/", "."))
        for n in ast.walk(tree):
            if isinstance(n, ast.ImportFrom):
                base = n.module or ""
                if n.level:
                    home = self.path.split("/")[: -n.level]
                    base = ".".join([*home, *([n.module] if n.module else [])])
                for a in n.names:
                    self.add("import", "*" if a.name == "*" else a.asname or a.name, module=base, real=a.name)
            elif isinstance(n, ast.Import):
                for a in n.names:
                    self.add("import_module", a.asname or a.name, module=a.name)
        self.block(tree.body, Scope())

    def block(self, body: list[ast.stmt], scope: Scope, holder: str = "") -> None:
        for stmt in body:
            if isinstance(stmt, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self.function(stmt, f"{holder}.{stmt.name}" if holder else stmt.name, holder)
            elif isinstance(stmt, ast.ClassDef):
                told = [x for x in stmt.body if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name)]
                fields = [[x.target.id, ast.unparse(x.annotation)] for x in told]
                self.add("class", stmt.name, bases=[b for x in stmt.bases if (b := scope.symbol(x.value if isinstance(x, ast.Subscript) else x))], fields=fields)
                self.block(stmt.body, Scope(stmt.name, frozenset(t.id for x in stmt.body if isinstance(x, ast.Assign) for t in x.targets if isinstance(t, ast.Name)), stmt.name), stmt.name)
            else:
                self.statement(stmt, scope)

    def statement(self, stmt: ast.stmt, scope: Scope) -> None:
        for n in [stmt, *_in_order(stmt)]:
            if isinstance(n, (ast.Assign, ast.AnnAssign, ast.NamedExpr)) and n.value is not None:
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    pairs = zip(t.elts, n.value.elts, strict=True) if isinstance(t, ast.Tuple) and isinstance(n.value, ast.Tuple) and len(t.elts) == len(n.value.elts) else [(t, n.value)]
                    for target, value in pairs:
                        if scope.symbol(target):
                            self.bound(scope.symbol(target), value, scope)
            elif isinstance(n, ast.Call):
                self.call(n, scope)

    def bound(self, symbol: str, value: ast.AST, scope: Scope) -> None:
        made = _value(value, scope)
        if made:
            self.add("value", symbol, **made)
        if isinstance(value, ast.Call) and _called(value) in ("StateGraph", "MessageGraph"):
            told = _keywords(value)
            state = told.get("state_schema", value.args[0] if value.args else None)
            self.add("graph", symbol, state=scope.symbol(state) if state is not None else "")

    def call(self, n: ast.Call, scope: Scope) -> None:
        callee, told = scope.symbol(n.func), _keywords(n)
        if _called(n) in CHAT_AGENTS:
            self.agent(n, scope)
        if callee:
            site = f"{n.lineno}:{n.col_offset}"
            for at, value in [*enumerate(n.args), *told.items()]:
                made = _value(value, scope)
                if made.get("said") or made.get("ref") or made.get("model") or made.get("names"):
                    self.add("argument", callee, at=str(at), site=site, **made)
        if not isinstance(n.func, ast.Attribute):
            return
        method, graph = n.func.attr, scope.symbol(n.func.value)
        text = lambda e: e.value if isinstance(e, ast.Constant) and isinstance(e.value, str) else "END" if scope.symbol(e).rpartition(".")[2] == "END" else "START" if scope.symbol(e).rpartition(".")[2] == "START" else scope.symbol(e).rpartition(".")[2]
        marks = {"__end__": "END", "__start__": "START"}
        if method == "add_node" and n.args:
            target = n.args[1] if len(n.args) > 1 else told.get("action", n.args[0])
            self.add("node", graph, node=text(n.args[0]), **_value(target, scope))
        elif method == "add_edge" and len(n.args) == 2:
            starts = n.args[0].elts if isinstance(n.args[0], (ast.List, ast.Tuple)) else [n.args[0]]
            for a in starts:
                self.add("edge", graph, src=marks.get(text(a), text(a)), dst=marks.get(text(n.args[1]), text(n.args[1])))
        elif method in ("set_entry_point", "set_finish_point") and n.args:
            self.add("edge", graph, **({"src": "START", "dst": text(n.args[0])} if method == "set_entry_point" else {"src": text(n.args[0]), "dst": "END"}))
        elif method == "add_conditional_edges" and len(n.args) >= 2:
            where = told.get("path_map", n.args[2] if len(n.args) > 2 else None)
            targets = [text(v) for v in (where.values if isinstance(where, ast.Dict) else where.elts if isinstance(where, (ast.List, ast.Tuple)) else [])]
            self.add("fan", graph, src=text(n.args[0]), router=scope.symbol(n.args[1]), targets=[marks.get(x, x) for x in targets])
        elif method == "compile" and graph:
            held = {k: _value(told[k], scope) for k in ("checkpointer", "store") if k in told and not isinstance(told[k], ast.Constant)}
            stops = {k: [text(e) for e in told[k].elts] for k in ("interrupt_before", "interrupt_after") if isinstance(told.get(k), (ast.List, ast.Tuple))}
            self.add("compile", graph, **{k: v.get("call") or v.get("ref", "").rpartition(".")[2] or k.title() for k, v in held.items()}, **stops)
        elif method in RUN_CALLS and graph and graph != "asyncio":
            first = n.args[0] if n.args else None
            task = told.get("task", told.get("message", first if method != "initiate_chat" else n.args[1] if len(n.args) > 1 else first if parts(first, scope) and not scope.symbol(first) else None))
            target = scope.symbol(told.get("recipient", first)) if method == "initiate_chat" and (first is not None or "recipient" in told) else ""
            self.add("run", graph, method=method, target=target, said=parts(task, scope) or [])

    def agent(self, n: ast.Call, scope: Scope) -> None:
        """What a chat agent's call refers to: its client, tools and memories, and older settings of its model."""
        told = _keywords(n)
        name = parts(told.get("name", n.args[0] if n.args else None), scope)
        config = {k.value: v for k, v in zip(told["llm_config"].keys, told["llm_config"].values, strict=True) if isinstance(k, ast.Constant)} if isinstance(told.get("llm_config"), ast.Dict) else {}
        first = config["config_list"].elts[0] if isinstance(config.get("config_list"), ast.List) and config["config_list"].elts else None
        old = {k.value: v for k, v in zip(first.keys, first.values, strict=True) if isinstance(k, ast.Constant)} if isinstance(first, ast.Dict) else config
        client = _value(told.get("model_client", told.get("llm_config")), scope)
        memories = told["memory"].elts if isinstance(told.get("memory"), ast.List) else []
        kinds = [_called(e) if isinstance(e, ast.Call) else "" for e in memories]
        mode = told.get("human_input_mode")
        self.add(
            "agent", name[0][1] if name and name[0][0] == "t" else "", cls=_called(n), client=client.get("ref", ""), model=client.get("model") or parts(old.get("model"), scope) or [],
            tools=_names(told.get("tools"), scope), tools_of=scope.symbol(told["tools"]) if "tools" in told else "", memories=[k for k in kinds if k], memories_of=[s for e in memories if (s := scope.symbol(e))],
            asks=_called(n) == "UserProxyAgent" or isinstance(mode, ast.Constant) and mode.value in ("ALWAYS", "TERMINATE"), described="description" in told,
        )

    def function(self, f: ast.FunctionDef | ast.AsyncFunctionDef, name: str, holder: str) -> None:
        nodes = list(ast.walk(f))
        given, own = _locals(f, nodes)
        scope = Scope(name, own, holder)
        calls = [n for n in nodes if isinstance(n, ast.Call)]
        nested = {x.name: x for x in f.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))}
        returns = [r.value for r in nodes if isinstance(r, ast.Return) and r.value is not None]
        goes = [_keywords(c)["goto"] for x in nested.values() for c in ast.walk(x) if isinstance(c, ast.Call) and _called(c) == "Command" and "goto" in _keywords(c)]
        made = [_value(r, scope) for r in returns if isinstance(r, ast.Call)]
        models = [v["model"] for c in calls if (v := _value(c, scope)).get("model")]
        system = _messages(nodes, scope, ("system",), "SystemMessage")
        named = [parts(x.value, scope) or [["h", ast.unparse(x.value), -1, ""]] for x in f.body if isinstance(x, ast.Assign) and isinstance(x.targets[0], ast.Name) and x.targets[0].id.lower() in PROMPT_NAMES]
        prompt = next((p for how, p in system if how == "call"), None) or (named[0] if named else None) or next((p for _, p in system), None)
        human = _messages(nodes, scope, ("user", "human"), "HumanMessage")
        invoked = [scope.symbol(c.func.value) for c in calls if isinstance(c.func, ast.Attribute) and c.func.attr in ("invoke", "ainvoke", "stream", "astream") and scope.symbol(c.func.value)]
        targets = f.returns.slice if isinstance(f.returns, ast.Subscript) and ast.unparse(f.returns.value).endswith("Literal") else None
        self.add(
            "function", name, doc=ast.get_docstring(f) or "", given=given, holder=holder, line=f.lineno,
            model=models[0] if models else None, prompt=prompt, human=human[0][1] if human else None, asks=any(_called(c) == "interrupt" for c in calls),
            invoked=list(dict.fromkeys(invoked)), keys=[k.value for r in returns if isinstance(r, ast.Dict) for k in r.keys if isinstance(k, ast.Constant) and isinstance(k.value, str)],
            plain=bool(returns) and all(isinstance(r, ast.Dict) for r in returns), tool_node=any(v.get("tool_node") for v in made),
            handler=any(isinstance(r, ast.Name) and r.id in nested for r in returns),
            dynamic=any(not (isinstance(g, ast.Constant) and isinstance(g.value, str)) for g in goes),
            targets=[e.value for e in ast.walk(targets) if isinstance(e, ast.Constant) and isinstance(e.value, str)] if targets is not None else [],
            says=[x for r in returns for v in ((r.body, r.orelse) if isinstance(r, ast.IfExp) else (r,)) if (x := _goal(v))],
            body="\n".join(ast.unparse(x) for x in (f.body[1:] if ast.get_docstring(f) is not None else f.body)), schema=_schema(f), public=not holder and not f.name.startswith("_") and f.name != "main",
        )
        for r in returns:
            value = _value(r, scope)
            if value:
                self.add("value", f"{name}()", **value)
        for stmt in f.body:
            if not isinstance(stmt, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                self.statement(stmt, scope)


def _schema(f: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    from .extract import signature_schema

    return json.dumps(signature_schema(f), sort_keys=True)


def facts(files: DataFrame, strict: bool = False) -> DataFrame:
    """FACT rows of (system_id, path, source). A file that does not parse has none, or, if strict, ends the run."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for g, path, source in zip(f.system_id, f.path, f.source, strict=True):
                try:
                    tree = ast.parse(source or "")
                except (SyntaxError, ValueError) as e:
                    if strict:
                        raise ValueError(f"{path}: {e}") from e
                    continue
                path = posixpath.normpath(path or "")
                rows += [(g, path, *r) for r in _File(path, tree).rows]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FACT.split(", ")])

    return files.select("system_id", "path", "source").mapInPandas(run, FACT)


def kept_facts(files: DataFrame, strict: bool = False) -> DataFrame:
    """The facts, written once; a part's rows lie by kind, so that who asks for one passes over the others' payloads."""
    return checkpointed(facts(files, strict).sortWithinPartitions("kind"))


VALUE = "ref string, `from` array<string>, names array<string>, call string, callee string, react boolean, tool_node boolean, tools array<string>, tools_of string, wraps string"


def symbol(path: Column | str, name: Column | str) -> Column:
    """A symbol as one key."""
    return F.concat(F.col(path) if isinstance(path, str) else path, F.lit("\x1f"), F.col(name) if isinstance(name, str) else name)


class Symbols:
    """Links and flows between the symbols of each system, and the questions asked along them."""

    def __init__(self, found: DataFrame):
        #: the tables of symbols grow with the facts, so they are dealt out where those are
        self.n_facts = found.count()
        self.found = dealt(found, self.n_facts)
        values = self.kept(self.of("value", VALUE).drop("payload"))  # read many times, so payloads are not parsed at each
        functions = self.kept(self.of("function", "given array<string>, holder string").drop("payload"))
        #: where a name is defined: what is assigned, functions and classes
        classes = self.of("class", "bases array<string>, fields array<array<string>>")
        self.defined = self.kept(values.select("system_id", "path", "name").union(functions.select("system_id", "path", "name")).union(classes.select("system_id", "path", "name")).distinct())
        self.classes = classes.withColumn("dst", symbol("path", "name"))
        plain = values.where("ref <> ''").select("system_id", symbol("path", "name").alias("src"), symbol("path", "ref").alias("dst"))
        self.links = self.kept(plain.union(self._imports()).distinct())
        means = self._closed(self.links)
        # a call binds its arguments to the parameters of the function that its name means
        bound = self.of("argument", "at string, site string, " + VALUE)
        by = bound.select("system_id", "path", "name", "at", "site", "ref", "payload").withColumn("src", symbol("path", "name"))
        callee = by.join(means, ["system_id", "src"]).withColumn("to", F.col("dst"))
        given = functions.select("system_id", symbol("path", "name").alias("to"), F.posexplode(F.expr("IF(holder = '', given, slice(given, 2, size(given)))")).alias("k", "parameter"))
        bindings = callee.join(given, ["system_id", "to"]).where((F.col("at") == F.col("k").cast("string")) | (F.col("at") == F.col("parameter")))
        self.bindings = self.kept(bindings.select("system_id", F.concat("to", F.lit("."), "parameter").alias("src"), symbol("path", F.coalesce("ref", F.lit(""))).alias("dst"), F.col("ref").isNotNull().alias("linked"), "to", F.concat_ws("\x1f", "path", "site").alias("site"), "payload"))
        self.links = self.links.union(self.bindings.where("linked").select("system_id", "src", "dst")).distinct()
        #: (system_id, src, dst): what a symbol stands for, itself included
        self.means = self.kept(self._closed(self.links))
        made = values.select("system_id", "path", "name", F.explode(F.array_union(F.coalesce("from", F.array().cast("array<string>")), F.array(F.concat("callee", F.lit("()"))))).alias("root")).where("root is not null and root <> '()'")
        calls = self.means.where(~F.col("dst").endswith("()")).select("system_id", F.concat("src", F.lit("()")).alias("src"), F.concat("dst", F.lit("()")).alias("dst")).where("src <> dst")
        flows = made.select("system_id", symbol("path", "name").alias("src"), symbol("path", "root").alias("dst"))
        #: (system_id, src, dst): what a symbol's value is made of, itself included
        self.made_of = self.kept(self._closed(self.links.union(flows).union(calls).distinct()))
        self.values = values.withColumn("dst", symbol("path", "name"))

    def dealt(self, rows: DataFrame) -> DataFrame:
        return dealt(rows, self.n_facts)

    def kept(self, rows: DataFrame) -> DataFrame:
        """Rows written once and read again, as joins should take them."""
        return self.dealt(checkpointed(rows))

    def of(self, kind: str, schema: str) -> DataFrame:
        rows = self.found.where(F.col("kind") == kind).withColumn("_x", F.from_json("payload", schema))
        return rows.select("system_id", "path", "name", "ord", "payload", "_x.*")

    def _closed(self, edges: DataFrame) -> DataFrame:
        ends = edges.select("system_id", "src").union(edges.select("system_id", F.col("dst").alias("src"))).union(self.defined.select("system_id", symbol("path", "name")))
        near = ends.distinct().withColumn("dst", F.col("src"))
        return transitive(edges, within="system_id").select("system_id", "src", "dst").union(near).distinct()

    def _imports(self) -> DataFrame:
        """Links of imported names: from this file's name to the name in the file that the module is.

        Of several files that a module's name fits, the one is taken that shares the longest beginning of
        its path with the importing file, then the first."""
        modules = self.found.where("kind = 'module'").select("system_id", F.col("name").alias("module"), F.col("path").alias("file"))
        whole = self.of("import_module", "module string").select("system_id", "path", "name", "module", F.lit("").alias("real"), "ord")
        named = self.of("import", "module string, real string").select("system_id", "path", "name", "module", "real", "ord")
        inner = named.where("real <> '*'").select("system_id", "path", "name", F.concat_ws(".", F.expr("nullif(module, '')"), "real").alias("module"), F.lit("").alias("real"), "ord")  # a module of a package
        asked = whole.union(named).union(inner)
        shared = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.slice(F.split("path", "/"), 1, k) == F.slice(F.split("file", "/"), 1, k)), lambda x: x))
        best = Window.partitionBy("system_id", "path", "name", "module", "real", "ord").orderBy(F.desc(shared), "file")
        met = asked.join(modules, ["system_id", "module"]).where("path <> file").withColumn("_k", F.row_number().over(best)).where("_k = 1")
        one = met.where("real not in ('', '*')").select("system_id", symbol("path", "name").alias("src"), symbol("file", "real").alias("dst"))
        defined = self.defined.select("system_id", F.col("path").alias("file"), F.col("name").alias("inner"))
        star = met.where("real = '*'").join(defined, ["system_id", "file"]).select("system_id", symbol("path", "inner").alias("src"), symbol("file", "inner").alias("dst"))
        dotted = met.where("real = ''").join(defined, ["system_id", "file"]).select("system_id", symbol("path", F.concat("name", F.lit("."), "inner")).alias("src"), symbol("file", "inner").alias("dst"))
        # names that a package hands on from its modules
        handed = named.where("real <> '*'").select("system_id", F.col("path").alias("file"), F.col("name").alias("inner"))
        again = met.where("real = ''").join(handed, ["system_id", "file"]).select("system_id", symbol("path", F.concat("name", F.lit("."), "inner")).alias("src"), symbol("file", "inner").alias("dst"))
        onward = met.where("real = '*'").join(handed, ["system_id", "file"]).select("system_id", symbol("path", "inner").alias("src"), symbol("file", "inner").alias("dst"))
        return reduce(DataFrame.union, [one, star, dotted, again, onward])

    def ancestors(self) -> DataFrame:
        """system_id, src, dst: a class and all that it inherits from, itself included, over files.

        What no file of the system defines is there as it is written in the file that names it."""
        bases = self.classes.select("system_id", F.col("dst").alias("src"), "path", F.explode("bases").alias("base")).withColumn("to", symbol("path", "base"))
        met = bases.select("system_id", F.col("src").alias("child"), F.col("to").alias("src")).join(self.means, ["system_id", "src"], "left")
        edges = met.select("system_id", F.col("child").alias("src"), F.coalesce("dst", "src").alias("dst")).distinct()
        own = self.classes.select("system_id", F.col("dst").alias("src"), "dst")
        return self.kept(transitive(edges, within="system_id").select("system_id", "src", "dst").union(own).distinct())

    @staticmethod
    def pieces(wanted: DataFrame) -> DataFrame:
        """system_id, id, path, place, part of (system_id, id, path, said)."""
        return wanted.select("system_id", "id", "path", F.posexplode("said").alias("k", "part")).select("system_id", "id", "path", F.array("k").alias("place"), "part")

    def by_call(self, wanted: DataFrame) -> DataFrame:
        """Pieces of (system_id, id, path, said), once for each call of the function whose parameters a text names.

        The id of such a text gets the call's place behind it."""
        known = self.bindings.select("system_id", F.col("src").alias("sought"), "to", "site", F.split("dst", "\x1f")[0].alias("of"), F.coalesce("payload", F.lit("{}")).alias("payload"))
        rows = self.pieces(wanted).withColumn("sought", F.when(F.col("part")[0] == "n", symbol("path", F.col("part")[1])))
        hit = rows.join(known, ["system_id", "sought"])
        sites = hit.select("system_id", "id", "to", "site").distinct()
        told = F.coalesce(F.from_json("payload", "said array<array<string>>").getField("said"), F.transform(F.array(F.from_json("payload", "ref string").getField("ref")), lambda r: F.array(F.lit("n"), r, r)))
        given = hit.select("system_id", "id", "site", F.col("of").alias("path"), "place", F.posexplode(told).alias("k", "part"))
        given = given.select("system_id", F.concat_ws("\x1f", "id", "site").alias("id"), "path", F.concat("place", F.array("k")).alias("place"), "part")
        same = hit.select("system_id", "id", "site", "place").distinct()
        rest = rows.join(sites.drop("to"), ["system_id", "id"]).join(same, ["system_id", "id", "site", "place"], "left_anti")
        rest = rest.select("system_id", F.concat_ws("\x1f", "id", "site").alias("id"), "path", "place", "part")
        others = rows.join(sites, ["system_id", "id"], "left_anti").select("system_id", "id", "path", "place", "part")
        return others.union(rest).union(given)

    def texts(self, wanted: DataFrame) -> DataFrame:
        """system_id, id, text of (system_id, id, path, said) or of pieces: parts with names looked up, over files and calls.

        A name that is bound more than once has its first text; one that has none stays a hole, as do
        names nested deeper than MOST_NESTED."""
        piece = "array<array<string>>"
        first = self.found.where("kind = 'value'").select("system_id", symbol("path", "name").alias("dst"), F.struct("path", "ord").alias("at"), F.from_json("payload", f"said {piece}").getField("said").alias("said"), "path")
        given = self.bindings.select("system_id", F.col("src").alias("dst"), F.struct(F.lit("~"), F.lit(0)).alias("at"), F.from_json("payload", f"said {piece}").getField("said").alias("said"), F.split("dst", "\x1f")[0].alias("path"))
        told = first.union(given).where("said is not null and size(said) > 0")
        # the texts of what a name stands for; its own come first
        known = self.means.join(told, ["system_id", "dst"]).groupBy("system_id", "src").agg(F.min_by(F.struct("said", "path"), F.struct((F.col("src") != F.col("dst")).alias("far"), "at", "dst")).alias("own"))
        known = self.kept(known.select("system_id", F.col("src").alias("sought"), F.col("own.said").alias("inner"), F.col("own.path").alias("of")))
        rows = self.pieces(wanted) if "said" in wanted.columns else wanted
        rows = rows.select("system_id", "id", "path", "place", "part", F.lit(False).alias("done"))
        for _ in range(MOST_NESTED):
            names = rows.where("part[0] = 'n' and not done").withColumn("sought", symbol("path", F.col("part")[1]))
            met = names.join(known, ["system_id", "sought"], "left")
            inside = met.where("inner is not null and not (size(inner) = 1 and inner[0][1] = part[1] and of = path)").select("system_id", "id", F.col("of").alias("path"), "place", F.posexplode("inner").alias("k", "part"))
            inside = inside.select("system_id", "id", "path", F.concat("place", F.array("k")).alias("place"), "part", F.lit(False).alias("done"))
            stays = met.where("inner is null or (size(inner) = 1 and inner[0][1] = part[1] and of = path)").select("system_id", "id", "path", "place", "part", F.lit(True).alias("done"))
            rows = self.kept(rows.where("part[0] <> 'n' or done").union(inside).union(stays))
            if rows.where("part[0] = 'n' and not done").isEmpty():
                break
        whole = rows.groupBy("system_id", "id").agg(F.expr("transform(array_sort(collect_list(struct(place, part))), x -> x.part)").alias("said"))
        return whole.select("system_id", "id", _shown(F.to_json("said")).alias("text"))


def _shown(said: Column) -> Column:
    def one(text: str) -> str:
        return rendered([[p[0], p[1], int(p[2]) if p[0] == "h" else p[2] if len(p) > 2 else p[1], *p[3:]] for p in json.loads(text)])

    return F.pandas_udf(lambda column: column.map(one, na_action="ignore"), "string")(said)
