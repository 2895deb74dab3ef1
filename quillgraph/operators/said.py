"""Texts that code builds: what a string expression says, with named holes for what only a run can tell.

A text is a list of parts [kind, value, ...]: "t" a literal, "n" a name to be looked up (with the source it
stands as), "h" a hole (source, conversion, format). `rendered` makes one text of parts: plain if it has no
holes, the source of an expression if it is one, else the source of an f-string.
"""

from __future__ import annotations

import ast
import re
import string
import textwrap

Part = list  # kind, value, and for holes conversion and format
#: Methods that leave a text's words as they are, and calls whose first argument is their text.
SAME = {"strip": str.strip, "lstrip": str.lstrip, "rstrip": str.rstrip, "dedent": textwrap.dedent, "cleandoc": textwrap.dedent}
OF_FIRST = ("from_template", "PromptTemplate", "SystemMessage", "HumanMessage", "str")
PLACE = re.compile(r"%(?:\((\w+)\))?[-+ #0]*\d*(?:\.\d+)?[sdrifgx]|%%")


class Scope:
    """How names are written as symbols: those of a function (or class) as `function.name`, others as they are."""

    def __init__(self, name: str = "", own: frozenset[str] = frozenset(), holder: str = ""):
        self.name, self.own, self.holder = name, own, holder

    def symbol(self, node: ast.AST) -> str:
        """The symbol of a name or of a dotted name; empty for anything else."""
        if isinstance(node, ast.Name):
            return f"{self.name}.{node.id}" if node.id in self.own else node.id
        if isinstance(node, ast.Attribute):
            head = self.symbol(node.value)
            if isinstance(node.value, ast.Name) and node.value.id in ("self", "cls") and self.holder:
                return f"{self.holder}.{node.attr}"
            return f"{head}.{node.attr}" if head else ""
        return ""


def hole(node: ast.AST, conversion: int = -1, form: str = "") -> Part:
    return ["h", ast.unparse(node), conversion, form]


def parts(node: ast.AST | None, scope: Scope) -> list[Part] | None:
    """The parts of a text, or None for what is no text."""
    match node:
        case ast.Constant(value=str(text)):
            return [["t", text]]
        case ast.JoinedStr(values=values):
            return [p for v in values for p in _formatted(v, scope)]
        case ast.Name() | ast.Attribute() if scope.symbol(node):
            return [["n", scope.symbol(node), ast.unparse(node)]]
        case ast.BinOp(op=ast.Add(), left=left, right=right):
            a, b = parts(left, scope), parts(right, scope)
            if not (a and _told(a) or b and _told(b)):
                return None
            return [*(a or [hole(left)]), *(b or [hole(right)])]
        case ast.BinOp(op=ast.Mod(), left=ast.Constant(value=str(text)), right=right):
            return _placed(text, right, scope)
        case ast.Call(func=ast.Attribute(value=held, attr="format")):
            inner = parts(held, scope)
            return _filled(inner[0][1], node, scope) if inner and len(inner) == 1 and inner[0][0] == "t" else inner
        case ast.Call(func=ast.Attribute(value=ast.Constant(value=str(by)), attr="join"), args=[ast.List(elts=each) | ast.Tuple(elts=each)]):
            out: list[Part] = []
            for k, e in enumerate(each):
                out += [["t", by]] if k else []
                out += parts(e, scope) or [hole(e)]
            return out
        case ast.Call(func=ast.Attribute(attr=name) | ast.Name(id=name), args=args):
            held = args[0] if args else node.func.value if isinstance(node.func, ast.Attribute) else None
            if name in SAME:
                inner = parts(held, scope)
                return [["t", SAME[name](inner[0][1])]] if inner and len(inner) == 1 and inner[0][0] == "t" else inner
            if name in OF_FIRST:
                told = {k.arg: k.value for k in node.keywords}
                return parts(told.get("content", told.get("template", args[0] if args else None)), scope)
    return None


def _told(found: list[Part]) -> bool:
    return any(p[0] in "th" for p in found) or any(p[0] == "n" for p in found)


def _formatted(v: ast.AST, scope: Scope) -> list[Part]:
    if isinstance(v, ast.Constant):
        return [["t", str(v.value)]]
    form = "".join(str(x.value) for x in v.format_spec.values if isinstance(x, ast.Constant)) if v.format_spec else ""
    if v.conversion < 0 and not form:
        inner = parts(v.value, scope) if isinstance(v.value, (ast.Constant, ast.JoinedStr, ast.Name, ast.Attribute)) else None
        if inner:
            return inner
    return [hole(v.value, v.conversion, form)]


def _placed(text: str, right: ast.AST, scope: Scope) -> list[Part]:
    """A text with % places, filled in order or by name."""
    named = {k.value: v for k, v in zip(right.keys, right.values, strict=True) if isinstance(k, ast.Constant)} if isinstance(right, ast.Dict) else {}
    rest = list(right.elts) if isinstance(right, ast.Tuple) else [right]
    out, at = [], 0
    for m in PLACE.finditer(text):
        out.append(["t", text[at : m.start()] + ("%" if m.group() == "%%" else "")])
        at = m.end()
        if m.group() != "%%":
            given = named.get(m[1]) if m[1] else rest.pop(0) if rest else None
            out += [["h", m[1] or "?", -1, ""]] if given is None else parts(given, scope) or [hole(given)]
    return [p for p in [*out, ["t", text[at:]]] if p[1]]


def _filled(text: str, call: ast.Call, scope: Scope) -> list[Part]:
    """A text with {places}, filled by the arguments of format; a place without an argument stays a hole."""
    named, out, next_one = {k.arg: k.value for k in call.keywords if k.arg}, [], 0
    try:
        pieces = list(string.Formatter().parse(text))
    except ValueError:
        return [["t", text]]
    for said, field, form, conversion in pieces:
        out.append(["t", said])
        if field is None:
            continue
        name, given = field, named.get(field)
        if not field or field.isdigit():
            place = int(field) if field else next_one
            next_one += not field
            given, name = (call.args[place] if place < len(call.args) else None), field or str(place)
        if given is not None and not form and not conversion:
            out += parts(given, scope) or [hole(given)]
        else:
            code = ord(conversion) if conversion else -1
            out.append(hole(given, code, form or "") if given is not None else ["h", name if name.isidentifier() else "_" + re.sub(r"\W", "_", name), code, form or ""])
    return [p for p in out if p[1]]


def rendered(found: list[Part]) -> str:
    """One text of parts; names that were not found are holes."""
    merged: list[Part] = []
    for p in found:
        if p[0] == "t" and merged and merged[-1][0] == "t":
            merged[-1] = ["t", merged[-1][1] + p[1]]
        elif p[0] != "t" or p[1]:
            merged.append(["h", p[2], -1, ""] if p[0] == "n" else list(p))
    if all(p[0] == "t" for p in merged):
        return "".join(p[1] for p in merged)
    if len(merged) == 1:
        return merged[0][1]
    holes, said = [_hole(p) for p in merged if p[0] == "h"], "".join(p[1] for p in merged if p[0] == "t")
    free = [q for q in ("'", '"', '"""', "'''") if not any(q in h for h in holes)] or ["'"]
    quote = next((q for q in free if q not in said), free[0])
    escaped = lambda t: t.replace("\\", "\\\\").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t").replace(quote, "\\" + quote).replace("{", "{{").replace("}", "}}")
    return f"f{quote}{''.join(escaped(p[1]) if p[0] == 't' else _hole(p) for p in merged)}{quote}"


def _hole(p: Part) -> str:
    return "{" + p[1] + (f"!{chr(p[2])}" if p[2] > 0 else "") + (f":{p[3]}" if p[3] else "") + "}"
