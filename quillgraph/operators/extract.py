"""Table functions over Python sources: feature sets, checks and pattern counts, and agents out of code.

Sources are parsed, never run. A file that does not parse gives no features and one error.
"""

from __future__ import annotations

import ast
import hashlib
import importlib.util
import json
import posixpath
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .closure import checkpointed
from .records import CONDITION


def _name(node: ast.AST | None) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{_name(node.value)}.{node.attr}" if _name(node.value) else node.attr
    if isinstance(node, (ast.Call, ast.Subscript)):
        return _name(node.func if isinstance(node, ast.Call) else node.value)
    return ""


def _last(node: ast.AST | None) -> str:
    return _name(node).rpartition(".")[2]


def _text(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _dotted(node: ast.AST | None) -> str:
    """a.b.c of names alone; empty for what is none."""
    return _name(node) if isinstance(node, (ast.Name, ast.Attribute)) else ""


def _marked(d: ast.AST) -> str:
    """A decorator as @name or @name(arguments): texts quoted, names, and ? for anything else."""
    if not isinstance(d, ast.Call):
        return f"@{_dotted(d) or '?'}"
    said = [f'"{_text(a)}"' if _text(a) is not None else _dotted(a) or "?" for a in d.args]
    return f"@{_dotted(d.func) or '?'}({', '.join(said)})"


#: Calls that build a state graph (fixed values).
GRAPH_CALLS = ("add_node", "add_edge", "add_conditional_edges", "set_entry_point", "set_finish_point")


def source_features(tree: ast.AST) -> set[tuple[str, str]]:
    """(feature, value) pairs: imports (top packages), classes, class_bases (of a class, in order of name), functions,
    decorators of functions, state_fields and state_annotations of TypedDict and BaseModel classes, graph_calls."""
    out: set[tuple[str, str]] = set()
    for n in ast.walk(tree):
        match n:
            case ast.Import():
                out |= {("imports", a.name.partition(".")[0]) for a in n.names}
            case ast.ImportFrom(module=str(module)):
                out.add(("imports", module.partition(".")[0]))
            case ast.ClassDef():
                bases = [_dotted(b) or "?" for b in n.bases]
                out |= {("classes", n.name), ("class_bases", ",".join(sorted(bases)))}
                if {b.rpartition(".")[2] for b in bases} & {"TypedDict", "BaseModel"}:
                    fields = [x for x in n.body if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name)]
                    out |= {("state_fields", x.target.id) for x in fields}
                    out |= {("state_annotations", f"{x.target.id}: {ast.unparse(x.annotation)}") for x in fields}
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                out |= {("functions", n.name), *(("decorators", _marked(d)) for d in n.decorator_list)}
            case ast.Call(func=ast.Attribute(attr=method)) if method in GRAPH_CALLS:
                first = n.args[0] if n.args else None
                said = "" if first is None else _text(first) if _text(first) is not None else _dotted(first) or ast.unparse(first)[:40]
                out.add(("graph_calls", f"{_dotted(n.func.value) or '?'}.{method}({said})"))
    return out


def features(files: DataFrame) -> DataFrame:
    """graph_id, feature, value of (graph_id, path, source) rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for g, source in zip(f.graph_id, f.source, strict=True):
                try:
                    rows += [(g, *x) for x in sorted(source_features(ast.parse(source or "")))]
                except (SyntaxError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=["graph_id", "feature", "value"])

    return files.select("graph_id", "source").mapInPandas(run, "graph_id string, feature string, value string").distinct()


def validity(files: DataFrame) -> DataFrame:
    """graph_id, files_checked, syntax_rate, import_rate, errors. A module next to the file counts as found."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for g, path, source in zip(f.graph_id, f.path, f.source, strict=True):
                try:
                    tree = ast.parse(source or "")
                    heads = {a.name.split(".")[0] for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names} | {(n.module or "").split(".")[0] for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) and not n.level}
                    rows.append((g, path, True, [h for h in sorted(heads) if h and importlib.util.find_spec(h) is None], None))
                except (SyntaxError, ValueError) as e:
                    rows.append((g, path, False, [], f"{path}: {e}"))
            yield pd.DataFrame(rows, columns=["graph_id", "path", "ok", "unknown", "error"])

    rows = files.select("graph_id", "path", "source").mapInPandas(run, "graph_id string, path string, ok boolean, unknown array<string>, error string")
    own = rows.select("graph_id", F.explode(F.split(F.regexp_replace("path", r"\.py$", ""), "/")).alias("m")).groupBy("graph_id").agg(F.collect_set("m").alias("own"))
    rows = rows.join(own, "graph_id").withColumn("found", F.col("ok") & (F.size(F.array_except("unknown", "own")) == 0))
    return rows.groupBy("graph_id").agg(F.count(F.lit(1)).alias("files_checked"), F.avg(F.col("ok").cast("double")).alias("syntax_rate"), F.avg(F.col("found").cast("double")).alias("import_rate"), F.array_sort(F.collect_set("error")).alias("errors"))


def _patterns(tree: ast.AST) -> Iterator[tuple[str, str]]:
    """(kind, key) of each countable pattern.

    class_base: every dotted end of a base, once a class. call_method: the method, and method(name) of a first
    argument that is a name. call_with_const: the method, if the first argument is a constant. decorator: its name, once a
    function. any_decorator: all names of a function, comma-joined. decorator_arg: the decorator, if called with a
    constant first, once a function. decorator_call_name: decorator(call) of a call among the arguments. reducer_field: an
    Annotated field. pydantic_default: a field with a value in a BaseModel class."""
    for n in ast.walk(tree):
        match n:
            case ast.ClassDef():
                bases = [_dotted(b.value if isinstance(b, ast.Subscript) else b) for b in n.bases]
                ends = {b.split(".", k)[-1] for b in bases if b for k in range(b.count(".") + 1)}
                yield from (("class_base", e) for e in sorted(ends))
                if any(_last(b) == "BaseModel" for b in n.bases if _dotted(b)):
                    yield from (("pydantic_default", "") for x in n.body if isinstance(x, ast.AnnAssign) and x.value is not None)
            case ast.FunctionDef() | ast.AsyncFunctionDef() if n.decorator_list:
                calls = [d for d in n.decorator_list if isinstance(d, ast.Call)]
                names = sorted({_dotted(d.func if isinstance(d, ast.Call) else d) for d in n.decorator_list})
                yield from (("decorator", x) for x in names)
                yield "any_decorator", ",".join(names)
                yield from (("decorator_arg", x) for x in sorted({_dotted(d.func) for d in calls if d.args and isinstance(d.args[0], ast.Constant)}))
                for d in calls:
                    yield from (("decorator_call_name", f"{_dotted(d.func)}({x})") for x in sorted({_dotted(a.func) for a in d.args if isinstance(a, ast.Call)}))
            case ast.AnnAssign(annotation=ast.Subscript(value=value)) if _dotted(value).endswith("Annotated"):
                yield "reducer_field", ""
            case ast.Call(func=ast.Attribute() | ast.Name()):
                method = _last(n.func)
                yield "call_method", method
                if n.args and _dotted(n.args[0]):
                    yield "call_method", f"{method}({_dotted(n.args[0])})"
                if n.args and isinstance(n.args[0], ast.Constant):
                    yield "call_with_const", method


def pattern_counts(files: DataFrame) -> DataFrame:
    """graph_id, kind, key, n of the countable patterns of sources."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for g, source in zip(f.graph_id, f.source, strict=True):
                try:
                    rows += [(g, *x) for x in _patterns(ast.parse(source or ""))]
                except (SyntaxError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=["graph_id", "kind", "key"])

    return files.select("graph_id", "source").mapInPandas(run, "graph_id string, kind string, key string").groupBy("graph_id", "kind", "key").agg(F.count(F.lit(1)).alias("n"))


def rule_counts(counts: DataFrame, rules: DataFrame) -> DataFrame:
    """graph_id, rule, n: how often each rule's pattern is there. rules: rule, kind, key; that of any_decorator is a
    comma-joined list, and a function counts once if it has one of them. What is not there has no row."""
    wanted = rules.select("rule", "kind", F.col("key").alias("_key"))
    hit = F.when(F.col("kind") == "any_decorator", F.arrays_overlap(F.split("key", ","), F.split("_key", ","))).otherwise(F.col("key") == F.col("_key"))
    return counts.join(F.broadcast(wanted), "kind").where(hit).groupBy("graph_id", "rule").agg(F.sum("n").alias("n"))


def rules_of(texts: DataFrame) -> DataFrame:
    """rule, side, kind, key of rule files (column text, YAML): a list `rules` of entries with `id` (or `name`) and sides.

    A side is a map of kinds to keys; a list of keys is several rows, but for any_decorator, where it is one that
    is comma-joined. Entries without a name or a side are left out; a file that is no YAML fails the job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for f in frames:
            rows = []
            for text in f.text:
                for rule in (yaml.safe_load(text or "") or {}).get("rules") or []:
                    name = str(rule.get("id", rule.get("name", "")))
                    for side, kinds in rule.items():
                        for kind, keys in kinds.items() if name and isinstance(kinds, dict) else ():
                            keys = [str(k) for k in (keys if isinstance(keys, list) else [keys])]
                            rows += [(name, side, kind, k) for k in ([",".join(keys)] if kind == "any_decorator" else keys)]
            yield pd.DataFrame(rows, columns=["rule", "side", "kind", "key"])

    return texts.select("text").mapInPandas(run, "rule string, side string, kind string, key string")


JSON_TYPES = {"str": "string", "int": "integer", "float": "number", "bool": "boolean"}  # fixed values


def fields_schema(fields: dict[str, dict[str, str] | str]) -> str:
    """The JSON Schema of fields (name: type, or a type and a description): compact, keys in order."""
    properties, required = {}, []
    for name, told in fields.items():
        kind, said = (told.get("type", "str"), told.get("description", "")) if isinstance(told, dict) else (told, "")
        bare = kind.removeprefix("Optional[").removesuffix("]") if kind.startswith("Optional[") else kind
        properties[name] = {"type": JSON_TYPES.get(bare, "string"), **({"description": said} if said else {}), **({"nullable": True} if kind.startswith("Optional") else {})}
        if not kind.startswith("Optional"):
            required.append(name)
    return json.dumps({"type": "object", "properties": properties, "required": required}, separators=(",", ":"), sort_keys=True)


def signature_schema(function: ast.FunctionDef | ast.AsyncFunctionDef) -> dict:
    """The JSON Schema of a function's parameters but self and cls; without any it is empty."""
    known = {**JSON_TYPES, "list": "array", "dict": "object"}
    names = [a for a in function.args.args if a.arg not in ("self", "cls")]
    properties = {a.arg: {"type": known.get(a.annotation.id, "string") if isinstance(a.annotation, ast.Name) else "string"} for a in names}
    return {"type": "object", "properties": properties, "required": [a.arg for a in names]} if names else {}


def python_text(text: Column) -> Column:
    """A text as it stands between double quotes in Python source."""
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def without_model(agents: DataFrame) -> DataFrame:
    """system_id, agent_key, role of agents that name no language model."""
    return agents.where("coalesce(llm, '') = ''").select("system_id", "agent_key", "role")


def entry_files(files: DataFrame) -> DataFrame:
    """graph_id, path of the likeliest entry point: main.py at the top, the first file there, the first main.py below, the largest."""
    top = ~F.col("path").contains("/")
    main = F.col("path").rlike(r"(^|/)main\.py$")
    rank = F.when(top & main, 0).when(top, 1).when(main, 2).otherwise(3)
    size = F.when(rank == 3, -F.octet_length("source")).otherwise(0)
    return files.groupBy("graph_id").agg(F.min_by("path", F.struct(rank, size, "path")).alias("path"))


def _keywords(call: ast.Call) -> dict[str, ast.AST]:
    return {k.arg: k.value for k in call.keywords if k.arg}


def _targets(router: ast.FunctionDef | ast.AsyncFunctionDef) -> list[str]:
    """Where a router may lead: the texts of its Literal annotation, or what it returns as texts or as END."""
    if isinstance(router.returns, ast.Subscript) and _last(router.returns) == "Literal":
        return [x for x in (_text(e) or _last(e) for e in ast.walk(router.returns.slice) if isinstance(e, (ast.Constant, ast.Name))) if x]
    values = [v for r in ast.walk(router) if isinstance(r, ast.Return) and r.value is not None for v in ((r.value.body, r.value.orelse) if isinstance(r.value, ast.IfExp) else (r.value,))]
    return list(dict.fromkeys(x for x in (_text(v) or ("END" if _last(v) == "END" else None) for v in values) if x))


def _commands(function: ast.AST) -> tuple[list[str], bool]:
    """The literal targets of Command(goto=...) in a function, in order, and whether there are others."""
    goals, open_ended = [], False
    for n in ast.walk(function):
        if isinstance(n, ast.Call) and _last(n.func) == "Command" and (goto := _keywords(n).get("goto")) is not None:
            for e in goto.elts if isinstance(goto, (ast.List, ast.Tuple)) else [goto]:
                goal = _text(e) or ("END" if _last(e) == "END" else None)
                goals, open_ended = ([*goals, goal], open_ended) if goal else (goals, True)
    return list(dict.fromkeys(goals)), open_ended


#: Conditions that end a group chat by a message of their kind.
EVENT_ENDS = ("TextMessageTermination", "HandoffTermination", "ExternalTermination")


def _ending(node: ast.AST | None, named: dict[str, ast.AST], depth: int = 0) -> dict | None:
    """What a termination condition says, through names and through | and &."""
    if isinstance(node, ast.Name):
        return _ending(named.get(node.id), named, depth + 1) if depth < 8 else None
    if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.BitOr, ast.BitAnd)):
        parts = [x for x in (_ending(e, named, depth) for e in (node.left, node.right)) if x]
        return {"type": "Composite", "operator": "OR" if isinstance(node.op, ast.BitOr) else "AND", "conditions": parts} if parts else None
    if not isinstance(node, ast.Call):
        return None
    kind, first = _last(node.func), node.args[0] if node.args else None
    if kind == "MaxMessageTermination":
        most = _keywords(node).get("max_messages", first)
        return {"type": "TurnLimit", "max_turns": most.value if isinstance(most, ast.Constant) else None}
    if kind == "TextMentionTermination":
        return {"type": "EventBased", "trigger": str(first.value) if isinstance(first, ast.Constant) else ""}
    return {"type": "EventBased", "trigger": kind} if kind in EVENT_ENDS else None


def _model_name(node: ast.AST | None) -> str | None:
    """The language model that a value names: a text, or LLM(model=...)."""
    if isinstance(node, ast.Call) and _last(node.func) == "LLM":
        return _text(_keywords(node).get("model", node.args[0] if node.args else None))
    return _text(node)


def _models(tree: ast.AST) -> Iterator[tuple[str, str, dict]]:
    """Classes of fields: subclasses of BaseModel and TypedDict, and of such classes in the file. Inputs of tools are none."""
    classes = [n for n in ast.walk(tree) if isinstance(n, ast.ClassDef)]
    known, more = {"BaseModel", "TypedDict"}, True
    while more:
        found = {c.name for c in classes if {_last(b) for b in c.bases} & known}
        more = not found <= known
        known |= found
    for c in classes:
        if c.name not in known or c.name.endswith("Input"):
            continue
        fields = {}
        for x in c.body:
            if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name):
                said = _keywords(x.value).get("description") if isinstance(x.value, ast.Call) else None
                fields[x.target.id] = {"type": ast.unparse(x.annotation), "description": _text(said) or ""}
        yield "model", c.name, {"schema": fields_schema(fields), "fields": {k: v["type"] for k, v in fields.items()}}


#: What decorators of a flow's methods make of them.
FLOW_STEPS = {"start": "start", "listen": "regular", "router": "conditional"}


def _flow_classes(tree: ast.AST, source: str) -> Iterator[tuple[str, str, dict]]:
    """Flow classes and their decorated methods: what they listen to, which crew they start, where routers lead and how."""
    lines = source.splitlines()
    for c in ast.walk(tree):
        base = next((b for b in c.bases if _last(b) == "Flow"), None) if isinstance(c, ast.ClassDef) else None
        if base is None:
            continue
        crews, order = set(), 0
        for m in c.body:
            marks = [d for d in getattr(m, "decorator_list", ()) if _last(d) in FLOW_STEPS]
            if not marks:
                continue
            kind, waits, joins = FLOW_STEPS[_last(marks[-1])], [], ""
            for a in [a for d in marks if isinstance(d, ast.Call) for a in d.args]:
                inner = a.args if isinstance(a, ast.Call) and _last(a.func) in ("or_", "and_") else [a]
                joins = _last(a.func) if inner != [a] else joins
                waits += [str(e.value) if isinstance(e, ast.Constant) else e.id for e in inner if isinstance(e, (ast.Constant, ast.Name))]
            starts = (n.func.value for n in ast.walk(m) if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in ("kickoff", "kickoff_async"))
            crew = next((_last(x.func.value.func) for x in starts if isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) and x.func.attr == "crew" and isinstance(x.func.value, ast.Call)), None)
            crews |= {crew} - {None}
            routes = kind == "conditional"
            body = "\n".join(lines[m.body[0].lineno - 1 : m.body[-1].end_lineno]) if routes else ""
            yield "flow_step", f"{c.name}.{m.name}", {"flow": c.name, "method": m.name, "ord": order, "type": kind, "waits": waits, "joins": joins, "crew": crew, "returns": _targets(m) if routes else [], "body": body}
            order += 1
        state = base.slice.id if isinstance(base, ast.Subscript) and isinstance(base.slice, ast.Name) else None
        yield "flow", c.name, {"state_model": state, "crews": sorted(crews)}


def _state_graph(tree: ast.AST) -> Iterator[tuple[str, str, dict]]:
    """Records of state-graph builders: nodes are steps and agents, edges lead, conditional edges fan out."""
    functions = {n.name: n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))}
    order = 0
    for n in ast.walk(tree):
        if not isinstance(n, ast.Call) or not isinstance(n.func, ast.Attribute):
            continue
        kind, args = n.func.attr, n.args
        if kind == "add_node" and args:
            name = _text(args[0]) or _last(args[0])
            made = functions.get(_last(args[1]) if len(args) > 1 else name)
            yield "step", name, {"ord": order, "doc": (ast.get_docstring(made) or "") if made else ""}
            order += 1
            goals, open_ended = _commands(made) if made else ([], False)
            if len(goals) == 1 and not open_ended:
                yield "edge", name, {"to": goals}
            elif goals or open_ended:
                yield "fan", name, {"mapping": {x: x for x in goals}, "router": made.name}
        elif kind == "add_edge" and len(args) == 2:
            yield "edge", _text(args[0]) or _last(args[0]), {"to": [_text(args[1]) or _last(args[1])]}
        elif kind == "add_conditional_edges" and len(args) >= 2:
            mapping = {}
            if len(args) > 2 and isinstance(args[2], ast.Dict):
                mapping = {_text(k) or _last(k): _text(v) or _last(v) for k, v in zip(args[2].keys, args[2].values, strict=True)}
            elif len(args) > 2 and isinstance(args[2], (ast.List, ast.Tuple)):
                mapping = {x: x for x in (_text(e) or _last(e) for e in args[2].elts)}
            router = functions.get(_last(args[1]))
            if router and not mapping:
                mapping = {x: x for x in _targets(router)}
            yield "fan", _text(args[0]) or _last(args[0]), {"mapping": mapping, "router": _last(args[1])}
        elif kind in ("set_entry_point", "set_finish_point") and args:
            target = _text(args[0]) or _last(args[0])
            yield "edge", "START" if kind == "set_entry_point" else target, {"to": [target if kind == "set_entry_point" else "END"]}


class _Found:
    """An agent, task or team call, and what other code calls it."""

    def __init__(self, kind: str, cls: str, node: ast.Call, scope: tuple[str, ...], home: tuple[str, ...], method: str, alias: str, owner: str):
        self.kind, self.cls, self.node, self.method, self.alias, self.owner = kind, cls, node, method, alias, owner
        self.scope, self.home = scope, home  # where the call stands, and where its name is known


class _Calls(ast.NodeVisitor):
    """Agent, task and team calls with the scope, name and decorated method that hold them; lists and imports by name."""

    def __init__(self, teams: dict[str, str]):
        self.teams, self.found, self.scope, self.method, self.owner = teams, [], (), "", ""
        self.name, self.home = "", ()
        self.lists: dict[tuple[tuple[str, ...], str], list[ast.List]] = {}
        self.imports: dict[str, tuple[str, str]] = {}
        self.settings: dict[str, dict[str, ast.AST]] = {}  # of classes

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        before = self.scope, self.owner, self.method, self.name
        self.scope, self.owner, self.method, self.name = (*self.scope, node.name), node.name, "", ""
        self.settings[node.name] = {t.id: x.value for x in node.body if isinstance(x, ast.Assign) for t in x.targets if isinstance(t, ast.Name)}
        self.generic_visit(node)
        self.scope, self.owner, self.method, self.name = before

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        before = self.scope, self.method, self.name
        marks = {_last(d) for d in node.decorator_list} & {"agent", "task", "crew"}
        self.scope, self.method, self.name = (*self.scope, node.name), f"{min(marks)}:{node.name}" if marks else "", ""
        self.generic_visit(node)
        self.scope, self.method, self.name = before

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            self.imports[a.asname or a.name] = (node.module or "", a.name)

    def _named(self, target: ast.AST, value: ast.AST | None) -> None:
        name, scope = _last(target), self.scope
        if isinstance(target, ast.Attribute) and _name(target.value) == "self" and len(scope) > 1:
            scope = scope[:-1]
        if isinstance(value, ast.List):
            self.lists.setdefault((scope, name), []).append(value)
        if isinstance(value, ast.Call):
            self.name, self.home = name, scope
        if value is not None:
            self.visit(value)
        self.name = ""

    def visit_Assign(self, node: ast.Assign) -> None:
        target = node.targets[0]
        if isinstance(target, (ast.Tuple, ast.List)) and isinstance(node.value, (ast.Tuple, ast.List)) and len(target.elts) == len(node.value.elts):
            for t, v in zip(target.elts, node.value.elts, strict=True):
                self._named(t, v)
        else:
            self._named(target, node.value)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self._named(node.target, node.value)

    def visit_NamedExpr(self, node: ast.NamedExpr) -> None:
        self._named(node.target, node.value)

    def visit_Return(self, node: ast.Return) -> None:
        """What a function returns goes by the function's name, outside it."""
        if isinstance(node.value, ast.Call) and self.scope:
            self.name, self.home = self.scope[-1], self.scope[:-1]
            self.visit(node.value)
            self.name = ""
        else:
            self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        cls = _last(node.func)
        kind = "agent" if cls in ("AssistantAgent", "UserProxyAgent", "Agent") else "task" if cls == "Task" else "team" if cls in self.teams or cls == "Crew" else ""
        if kind:
            mark, _, method = self.method.partition(":")
            method = method if mark == {"team": "crew"}.get(kind, kind) else ""
            home = self.scope[:-1] if method else self.home if self.name else self.scope
            self.found.append(_Found(kind, cls, node, self.scope, home, method, method or self.name, self.owner))
        self.name = ""
        self.generic_visit(node)


def _group_chat(tree: ast.AST, teams: dict[str, str]) -> Iterator[tuple[str, str, dict]]:
    """Records of assistant and team calls: keyword arguments that are text, and what they refer to.

    `_at` is the call's place, `_alias` the name it goes by at module level; `_refs` are places where
    known, else names with the module that they are imported from."""
    calls = _Calls(teams)
    calls.visit(tree)
    at = {id(x.node): k for k, x in enumerate(calls.found)}

    def meant(e: ast.AST, kind: str, user: _Found) -> dict:
        if id(e) in at:
            return {"at": at[id(e)], "name": _last(e)}
        name, place = _last(e), (user.node.lineno, user.node.col_offset)
        for depth in range(len(user.scope), -1, -1):
            own = [x for x in calls.found if x.kind == kind and x.alias == name and x.home == user.scope[:depth]]
            if own:
                early = [x for x in own if (x.node.lineno, x.node.col_offset) < place]
                return {"at": at[id((early[-1] if early else own[0]).node)], "name": name}
        module, real = calls.imports.get(name, ("", name))
        return {"module": module, "name": real}

    def listed(n: ast.Call, user: _Found) -> list[ast.AST]:
        kw = _keywords(n)
        for x in (kw.get("participants"), kw.get("agents"), n.args[0] if n.args else None):
            if isinstance(x, ast.List):
                return x.elts
            for depth in range(len(user.scope), -1, -1):
                own = calls.lists.get((user.scope[:depth], _last(x)), []) if isinstance(x, (ast.Name, ast.Attribute)) else []
                if own:
                    early = [y for y in own if y.lineno <= n.lineno]
                    return (early[-1] if early else own[0]).elts
            if isinstance(x, ast.Attribute) and x.attr == "agents" and _name(x.value) == "self":
                return [y.node for y in calls.found if y.kind == "agent" and y.method and y.owner == user.owner and y.home == user.scope[: len(y.home)]]
        return []

    named = {t.id: n.value for n in ast.walk(tree) if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)}
    names = lambda e: [_last(y.func if isinstance(y, ast.Call) else y) for y in e.elts] if isinstance(e, (ast.List, ast.Tuple)) else []

    def configured(x: _Found, kw: dict[str, ast.AST]) -> dict:
        """The YAML file, beside the source, and the key in it that a call in a class refers to."""
        config, of = kw.get("config"), f"{x.kind}s_config"
        if isinstance(config, ast.Subscript):
            key, of = _text(config.slice), _last(config)
        elif isinstance(config, ast.Call):
            key, of = _text(config.args[0]) if config.args else None, _last(config.func.value) if isinstance(config.func, ast.Attribute) else of
        else:
            key = None
        file = _text(calls.settings.get(x.owner, {}).get(of))
        return {"config_file": file, "config_key": key or x.method or x.alias} if file else {}

    def rails(e: ast.AST | None) -> list[str]:
        if isinstance(e, (ast.List, ast.Tuple)):
            return [r for y in e.elts for r in rails(y)]
        return [] if e is None else [f"LLMBased:{_text(e)}"] if _text(e) is not None else [f"FunctionBased:{_last(e)}"] if _last(e) else []

    for k, x in enumerate(calls.found):
        n, cls, kw = x.node, x.cls, _keywords(x.node)
        said = {a: _text(v) for a, v in kw.items() if _text(v) is not None}
        said |= {a: v.value for a, v in kw.items() if isinstance(v, ast.Constant) and isinstance(v.value, (bool, int))}
        said |= configured(x, kw)
        own = {"_at": k, "_alias": x.alias if not x.home else ""}
        if x.kind == "agent":
            key = x.method or said.get("name") or (_text(n.args[0]) if n.args else None) or said.get("role") or x.alias or cls
            tools = [_last(e) for e in kw["tools"].elts] if isinstance(kw.get("tools"), ast.List) else []
            model = _model_name(kw.get("llm")) or _model_name(named.get(_last(kw.get("llm")))) or _model_name(calls.settings.get(x.owner, {}).get("llm"))
            yield "agent", key, {**said, **({"llm": model} if model else {}), "class": cls, "tools": tools, **own, "_key": key}
        elif x.kind == "task":
            refs = [meant(kw["agent"], "agent", x)] if kw.get("agent") is not None else []
            more = {"context": names(kw.get("context")), "tools": names(kw.get("tools")), "guardrails": [*rails(kw.get("guardrail")), *rails(kw.get("guardrails"))]}
            more |= {c: _last(kw[c]) for c in ("output_pydantic", "output_json") if c in kw}
            yield "task", x.method or said.get("name") or x.alias or cls, {**said, **more, "agent": _last(kw.get("agent")), **own, "_refs": refs}
        else:
            turns = kw.get("max_turns", kw.get("max_round"))
            end = _ending(kw.get("termination_condition"), named)
            ends = [end] if end else []
            work = [y.method for y in calls.found if y.kind == "task" and y.method and y.owner == x.owner] if x.method and x.owner else []
            crew = {c: said[c] for c in ("verbose", "memory", "manager_llm") if c in said} | {"process": _last(kw.get("process")) or "sequential", "tasks": work} if cls == "Crew" else {}
            refs = [meant(e, "agent", x) for e in listed(n, x)]
            title = x.owner if x.method and x.owner else cls
            yield "team", title, {"class": title, "members": [r["name"] for r in refs], "pattern": teams.get(cls, "Sequential"), "max_turns": turns.value if isinstance(turns, ast.Constant) else None, "terminations": ends, **crew, **own, "_refs": refs}


REFS = "_refs array<struct<at:int,name:string,module:string>>, _at int, _alias string, _key string"


def _settled(each: DataFrame) -> DataFrame:
    """Rows with a key of its own for each agent, task and team, references as such keys, and `ord` by path.

    Keys of a system that would fall together as names in a graph get a mark made of path and ordinal; names
    that a file does not define are looked up in the module that it imports them from, then in the system.
    All of it is joins and windows on narrower keys than the system, so a system of many files spreads."""
    each = checkpointed(each).withColumn("_x", F.from_json("payload", REFS))
    sizes = each.groupBy("system_id", "path", "file").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("system_id").orderBy("path", "file")) - F.col("n")
    named = F.col("kind").isin("agent", "task", "team")
    alike = Window.partitionBy("system_id", "kind", F.when(named, F.translate("key", " -.", "___")).otherwise(F.concat_ws("\x1f", "path", "file", F.col("ord"))))
    nth = F.row_number().over(Window.partitionBy("system_id", "kind", F.translate("key", " -.", "___"), "path").orderBy("file", "ord"))
    rows = each.join(sizes.withColumn("begin", before).drop("n"), ["system_id", "path", "file"]).withColumn("many", named & (F.count(F.lit(1)).over(alike) > 1)).withColumn("nth", nth)
    mark = F.substring(F.md5(F.concat("path", F.lit("#"), F.col("nth").cast("string")).cast("binary")), 1, 12)
    rows = rows.withColumn("key", F.when(F.col("many"), F.concat_ws("_", "key", mark)).otherwise(F.col("key")))
    rows = checkpointed(rows.withColumn("place", F.col("ord")).withColumn("ord", F.col("begin") + F.col("ord")).drop("begin", "many", "nth"))

    called = rows.where("kind = 'agent'").select("system_id", "path", "key", F.explode(F.array_distinct(F.array("_x._alias", "_x._key"))).alias("name")).where("name <> ''")
    anywhere = called.groupBy("system_id", "name").agg(F.min("key").alias("only"), F.count_distinct("key").alias("kinds"))
    steps = F.split(F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/__init__$", ""), "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, k, F.size(steps)), "/"))
    near = called.select("system_id", "name", "key", F.explode(ends).alias("module")).groupBy("system_id", "name", "module").agg(F.min("key").alias("near"), F.count_distinct("key").alias("near_kinds"))
    refs = rows.where("size(_x._refs) > 0").select("system_id", "path", "file", "place", F.posexplode("_x._refs").alias("k", "ref"))
    module = F.translate(F.trim(F.coalesce("ref.module", F.lit("")), F.lit(".")), ".", "/")
    refs = refs.select("system_id", "path", "file", "place", "k", F.col("ref.at").alias("at"), F.col("ref.name").alias("name"), module.alias("module"))
    placed = rows.where("_x._at is not null").select("system_id", "path", "file", F.col("_x._at").alias("at"), F.col("key").alias("placed"))
    refs = refs.join(placed, ["system_id", "path", "file", "at"], "left").join(near, ["system_id", "name", "module"], "left").join(anywhere, ["system_id", "name"], "left")
    meant = F.when(F.col("at").isNotNull(), F.col("placed")).when(F.col("near").isNotNull(), F.when(F.col("near_kinds") == 1, F.col("near"))).when(F.col("kinds") == 1, F.col("only"))
    names = refs.withColumn("meant", F.coalesce(meant, "name")).groupBy("system_id", "path", "file", "place").agg(F.expr("transform(array_sort(collect_list(struct(k, meant))), x -> x.meant)").alias("names"))
    rows = rows.join(names, ["system_id", "path", "file", "place"], "left")
    return rows.select("system_id", "kind", "key", "ord", _referring("kind", "payload", "names").alias("payload"))


def _referring(kind: str, payload: str, names: str) -> Column:
    """Payloads with the names that they refer to, without what served to find them."""

    def run(kinds: pd.Series, payloads: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for k, text, refs in zip(kinds, payloads, found, strict=True):
            p, refs = json.loads(text), [] if refs is None else list(refs)
            if k == "team":
                p["members"] = refs
            elif k == "task" and refs:
                p["agent"] = refs[0]
            if k == "agent" and not p.get("name"):
                p["name"] = p["_key"]
            out.append(json.dumps({c: v for c, v in p.items() if c not in ("_refs", "_at", "_alias", "_key")}, sort_keys=True))
        return pd.Series(out)

    return F.pandas_udf(run, "string")(kind, payload, names)


#: How team classes coordinate.
TEAM_CLASSES = {"RoundRobinGroupChat": "RoundRobin", "GroupChat": "RoundRobin", "SelectorGroupChat": "SelectorBased", "Swarm": "Swarm", "MagenticOneGroupChat": "Custom"}


def program_records(files: DataFrame, strict: bool = False) -> DataFrame:
    """system_id, kind (agent, task, team, step, edge, fan, tool, model, flow, flow_step), key, ord, payload (JSON) of sources.

    A file that does not parse is skipped, or, if strict, ends the run with an error that names it. Tools are functions with a tool decorator and subclasses of BaseTool. Each agent, task and team call
    is a record with a key of its own; `ord` counts a system's records by path."""

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
                file = hashlib.md5(f"{path}\0{source}".encode("utf-8", "replace")).hexdigest()
                found = [*_group_chat(tree, TEAM_CLASSES), *_state_graph(tree), *_models(tree), *_flow_classes(tree, source or "")]
                for _, _, payload in found:
                    if payload.get("config_file"):
                        payload["config_file"] = posixpath.normpath(posixpath.join(posixpath.dirname(path or ""), payload["config_file"]))
                for n in ast.walk(tree):
                    tool = isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and any(_last(d) == "tool" for d in n.decorator_list) or isinstance(n, ast.ClassDef) and any(_last(b) == "BaseTool" for b in n.bases)
                    if tool:
                        found.append(("tool", n.name, {"description": ast.get_docstring(n) or "", "reference": path}))
                rows += [(g, path or "", file, kind, key, k, json.dumps(payload, sort_keys=True)) for k, (kind, key, payload) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["system_id", "path", "file", "kind", "key", "ord", "payload"])

    schema = "system_id string, kind string, key string, ord long, payload string"
    each = files.select("system_id", "path", "source").mapInPandas(run, schema.replace("kind", "path string, file string, kind"))
    return _settled(each)


def to_records(found: DataFrame, framework: str, namespace: str = "http://example.org/", entries: DataFrame | None = None) -> dict[str, DataFrame]:
    """Records for lifting out of program_records: every agent, task and team; of steps, fans and tools the last one of a key.

    entries: system_id, path, key, fields of YAML files, as sources.trees reads them; agents and tasks that a class
    configures there take from them what their calls do not say."""
    last = lambda kind, schema: found.where(F.col("kind") == kind).groupBy("system_id", "key").agg(F.max_by("payload", "ord").alias("payload"), F.max("ord").alias("ord")).withColumn("x", F.from_json("payload", schema))
    none = found.select("system_id", F.lit("").alias("path"), "key", F.create_map().cast("map<string,string>").alias("fields")).limit(0)
    told = (none if entries is None else entries.select("system_id", "path", "key", "fields")).toDF("system_id", "_path", "_entry", "_fields")
    filled = lambda df: df.join(told, (df.system_id == told.system_id) & (F.col("x.config_file") == F.col("_path")) & (F.col("x.config_key") == F.col("_entry")), "left").drop(told.system_id)
    given = lambda c: F.nullif(F.regexp_replace(F.element_at("_fields", F.lit(c)), r"^\s+|\s+$", ""), F.lit(""))
    agents = last("agent", "verbose boolean, allow_delegation boolean, memory boolean, reasoning boolean, max_reasoning_attempts int, config_file string, config_key string, name string, role string, goal string, backstory string, system_message string, description string, model string, llm string, class string, tools array<string>")
    cut = F.split(F.coalesce("x.system_message", F.lit("")), r"\. ", 2)
    sentence = F.when(F.size(cut) > 1, F.concat(F.trim(cut[0]), F.lit("."))).otherwise(F.trim(cut[0]))
    goal, backstory = F.coalesce("x.goal", given("goal"), sentence), F.coalesce("x.backstory", given("backstory"), F.trim(F.get(cut, F.lit(1))))
    no = F.lit(False)
    agents = filled(agents).select("system_id", F.col("key").alias("agent_key"), F.coalesce("x.role", given("role"), "x.name", "key").alias("role"), goal.alias("goal"), backstory.alias("backstory"), F.coalesce("x.llm", "x.model", given("llm")).alias("llm"), "x.tools", F.coalesce("x.reasoning", no).alias("reasoning"), "x.max_reasoning_attempts", F.coalesce("x.memory", no).alias("memory"), "x.verbose", "x.allow_delegation", F.col("x.description").alias("description"), F.when(F.col("x.class") == "UserProxyAgent", "UserProxy").otherwise("GeneralPurpose").alias("agent_type"), (F.col("x.class") == "UserProxyAgent").alias("human_input"))
    steps = last("step", "ord int, doc string")
    edges = found.where("kind = 'edge'").select("system_id", F.col("key").alias("src"), F.explode(F.from_json("payload", "to array<string>").getField("to")).alias("dst")).distinct()
    fans = last("fan", "mapping map<string,string>, router string").select("system_id", F.col("key").alias("src"), "x.mapping", "x.router")
    out = edges.where("dst <> 'END' and src <> 'START'").groupBy("system_id", "src").agg(F.array_sort(F.collect_set("dst")).alias("outgoing"))
    begins = edges.where("src = 'START'").select("system_id", F.col("dst").alias("key")).withColumn("starts", F.lit(True))
    steps = steps.join(out.withColumnRenamed("src", "key"), ["system_id", "key"], "left").join(fans.withColumnRenamed("src", "key"), ["system_id", "key"], "left").join(begins, ["system_id", "key"], "left")
    kind = F.when(F.col("starts"), "start").when(F.col("mapping").isNotNull(), "conditional").otherwise("regular")
    flow_steps = steps.select("system_id", F.lit("StateGraph").alias("flow"), F.col("x.ord").alias("ord"), F.col("key").alias("method_name"), kind.alias("step_type"), F.array().cast("array<string>").alias("dependencies"), F.array_sort(F.map_values("mapping")).alias("return_values"), F.col("router").alias("function_body"), F.col("key").alias("associated_agent_key"), F.col("mapping").alias("edge_mapping"), "outgoing")
    node_agents = steps.join(agents.select("system_id", F.col("agent_key").alias("key")), ["system_id", "key"], "left_anti").select("system_id", F.col("key").alias("agent_key"), F.col("key").alias("role"), F.col("x.doc").alias("goal"), F.lit(False).alias("reasoning"), F.lit(False).alias("memory"))
    tasks = filled(last("task", "config_file string, config_key string, description string, expected_output string, agent string, context array<string>, tools array<string>, guardrails array<string>, guardrail_max_retries int, output_pydantic string, output_json string, human_input boolean"))
    by = F.coalesce(F.nullif("x.agent", F.lit("")), given("agent"), "x.agent")
    tasks = tasks.select("system_id", F.col("key").alias("task_key"), F.coalesce("x.description", given("description")).alias("description"), F.coalesce("x.expected_output", given("expected_output")).alias("expected_output"), by.alias("agent_key"), F.when(by != "", "ExplicitAssignment").alias("delegation_strategy"), "x.tools", F.col("x.context").alias("context_tasks"), "x.guardrails", "x.guardrail_max_retries", "x.output_pydantic", "x.output_json", F.coalesce("x.human_input", no).alias("human_input"))
    teams = last("team", f"class string, members array<string>, pattern string, max_turns int, process string, tasks array<string>, verbose boolean, memory boolean, manager_llm string, terminations array<{CONDITION}>")
    pattern = F.when(F.col("x.process").isNull(), F.col("x.pattern"))  # of a crew its process tells
    teams = teams.select("system_id", F.col("key").alias("team_key"), F.coalesce("x.class", "key").alias("team_class_name"), F.col("x.members").alias("agent_keys"), F.coalesce("x.tasks", F.array().cast("array<string>")).alias("task_keys"), F.coalesce("x.process", F.lit("sequential")).alias("process"), F.coalesce("x.verbose", no).alias("verbose"), F.coalesce("x.memory", no).alias("memory"), "x.manager_llm", pattern.alias("coordination_pattern"), "x.max_turns", F.col("x.terminations").alias("termination_conditions"), "ord")
    tools = last("tool", "description string, reference string").select("system_id", F.col("key").alias("tool_key"), F.col("key").alias("class_name"), F.col("key").alias("name"), "x.description", F.col("x.reference").alias("implementation_ref"))
    ids = found.select("system_id").distinct()
    systems = ids.select("system_id", F.col("system_id").alias("name"), F.lit(framework).alias("framework"), F.concat(F.lit(namespace), F.col("system_id"), F.lit("#")).alias("namespace"))
    models = last("model", "schema string, fields map<string,string>")
    state = models.select("system_id", F.col("key").alias("state_model"), F.col("x.fields").alias("state_fields"))
    models = models.select("system_id", F.col("key").alias("class_name"), F.col("x.schema").alias("schema_json"))
    made = last("flow", "state_model string, crews array<string>").select("system_id", F.col("key").alias("class_name"), "x.state_model", F.col("x.crews").alias("crew_references")).join(state, ["system_id", "state_model"], "left")
    flows = flow_steps.select("system_id", F.lit("StateGraph").alias("class_name")).distinct().unionByName(made, allowMissingColumns=True)
    own = last("flow_step", "flow string, method string, ord int, type string, waits array<string>, joins string, crew string, returns array<string>, body string")
    own = own.select("system_id", "x.flow", "x.ord", F.col("x.method").alias("method_name"), F.col("x.type").alias("step_type"), F.col("x.waits").alias("dependencies"), F.col("x.returns").alias("return_values"), F.col("x.body").alias("function_body"), F.col("x.crew").alias("calls_crew"), F.nullif("x.joins", F.lit("")).alias("aggregation_combinator"))
    flow_steps = flow_steps.unionByName(own, allowMissingColumns=True)
    return {"systems": systems, "agents": agents.unionByName(node_agents, allowMissingColumns=True), "tasks": tasks, "teams": teams, "tools": tools, "flows": flows, "flow_steps": flow_steps, "models": models}
