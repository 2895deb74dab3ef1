"""Turtle text as tokens, statements and triples, line by line: what is held is one statement.

A reader may begin at any line, given the quotes that are open there, the line's number and the prefixes
so far; `turtle.read` finds these for each part of a large file.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from urllib.parse import urljoin

from ..functions import terms as T

LEX = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><(?:[^<>"{}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)"""
    r"""|(?P<text>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')"""
    r"""|(?P<at>@prefix\b|@base\b|@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<blank>_:[\w](?:[\w.-]*[\w-])?)|(?P<num>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))"""
    r"""|(?P<name>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-])(?:(?:[\w.:-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-])*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-]))?)?)|(?P<word>[A-Za-z]+)|(?P<sign>\^\^|[.;,\[\]()])""",
    re.DOTALL,
)
CLOSE = {q: re.compile(r"\\.|" + q, re.DOTALL) for q in ('"""', "'''")}
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
NIL, FIRST, REST = T.iri(T.RDF + "nil"), T.iri(T.RDF + "first"), T.iri(T.RDF + "rest")
#: Nested brackets of one statement; deeper ones are an error of the document.
MOST_DEPTH = 200

Token = tuple[str, str, int, int]  # kind, text, line, column


def plain(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[1] or m[2]:
            return chr(int(m[1] or m[2], 16))
        if m[3] not in ESCAPES:
            raise ValueError(f"unknown escape \\{m[3]}")
        return ESCAPES[m[3]]

    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", one, text, flags=re.DOTALL) if "\\" in text else text


class Lexer:
    """Tokens of lines that are fed one after another; a text in triple quotes may go on over lines."""

    def __init__(self, quote: str = "", line: int = 0):
        self.quote, self.line, self.parts, self.begun = quote, line, [], (line, 0)

    def feed(self, text: str) -> list[Token]:
        out, k = [], 0
        while k < len(text):
            if self.quote:
                end = next((m for m in CLOSE[self.quote].finditer(text, k) if m.group() == self.quote), None)
                self.parts.append(text[k : end.end() if end else len(text)])
                if not end:
                    break
                out.append(("long", self.quote + "".join(self.parts), *self.begun))
                self.quote, self.parts, k = "", [], end.end()
            elif text.startswith(('"""', "'''"), k):
                self.quote, self.begun, k = text[k : k + 3], (self.line, k), k + 3
            else:
                m = LEX.match(text, k)
                if not m:
                    raise ValueError(f"unexpected {text[k : k + 25]!r} in line {self.line + 1}, column {k + 1}")
                if m.lastgroup:
                    out.append((m.lastgroup, m.group(), self.line, k))
                k = m.end()
        self.line += 1
        return out


def directive(token: Token) -> str:
    """PREFIX or BASE if the token begins a directive, else empty. No other statement holds such a word."""
    word = token[1].removeprefix("@").upper() if token[0] in ("at", "word") else ""
    return word if word in ("PREFIX", "BASE") and (token[0] == "word" or token[1].islower()) else ""


class Splitter:
    """Statements out of tokens: up to a full stop, or a directive without one; a directive always begins anew."""

    def __init__(self):
        self.open: list[Token] = []

    def push(self, token: Token) -> Iterator[list[Token]]:
        if directive(token) and self.open:
            yield self.taken()
        self.open.append(token)
        if token[:2] == ("sign", ".") or self.open[0][0] == "word" and len(self.open) == {"PREFIX": 3, "BASE": 2}.get(directive(self.open[0])):
            yield self.taken()

    def taken(self) -> list[Token]:
        done, self.open = self.open, []
        return done


def statements(lines: Iterable[str], lexer: Lexer, splitter: Splitter) -> Iterator[list[Token]]:
    for text in lines:
        for token in lexer.feed(text):
            yield from splitter.push(token)


class Names:
    """Base and prefixes in effect."""

    def __init__(self, base: str = "", prefixes: dict[str, str] | None = None):
        self.base, self.prefixes = base, dict(prefixes or {})

    def iri(self, text: str) -> str:
        text = plain(text)
        if self.base and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", text):
            text = urljoin(self.base, text) if text else self.base
        return text

    def take(self, said: list[str]) -> None:
        """A directive's word and what follows it, without a full stop."""
        word = said[0].removeprefix("@").upper()
        if len(said) != {"PREFIX": 3, "BASE": 2}[word] or not said[-1].startswith("<") or word == "PREFIX" and not said[1].endswith(":"):
            raise ValueError(f"not a directive: {' '.join(said)}")
        if word == "PREFIX":
            self.prefixes[said[1][:-1]] = self.iri(said[2][1:-1])
        else:
            self.base = self.iri(said[1][1:-1])


class Statement:
    """A recursive-descent reader of one statement. Nodes without a label are named by its place."""

    def __init__(self, tokens: list[Token], names: Names, scope: str):
        self.tokens, self.names, self.scope, self.at, self.made, self.depth = [*tokens, ("end", "", *tokens[-1][2:])], names, scope, 0, 0, 0
        self.out: list[tuple[str, str, str]] = []

    def next(self, *wanted: str) -> tuple[str, str]:
        kind, said, line, column = self.tokens[self.at]
        if wanted and said not in wanted or kind == "end":
            raise ValueError(f"expected {' or '.join(wanted) or 'more'}, found {said!r} in line {line + 1}, column {column + 1}")
        self.at += 1
        return kind, said

    @property
    def said(self) -> str:
        return self.tokens[self.at][1]

    @property
    def kind(self) -> str:
        return self.tokens[self.at][0]

    def fresh(self) -> str:
        self.made += 1
        return f"_:{self.scope}g{self.tokens[0][2]}c{self.tokens[0][3]}n{self.made}"

    def triples(self) -> list[tuple[str, str, str]]:
        if directive(self.tokens[0]):
            said = [t[1] for t in self.tokens[:-1]]
            if said[0].startswith("@") and said.pop() != ".":
                raise ValueError(f"a directive without a full stop in line {self.tokens[0][2] + 1}")
            self.names.take(said)
            return []
        bare = self.said == "["
        s = self.object()
        if s.startswith('"'):
            raise ValueError(f"a literal cannot be a subject: {s}")
        if not (bare and self.said == "."):
            self.properties(s)
        self.next(".")
        if self.kind != "end":
            raise ValueError(f"expected the end of the statement, found {self.said!r}")
        return self.out

    def properties(self, s: str) -> None:
        while True:
            if self.kind == "word" and self.said == "a":
                p = T.TYPE
                self.next()
            else:
                p = self.object()
                if not p.startswith("<"):
                    raise ValueError(f"a predicate must be an IRI: {p}")
            while True:
                self.out.append((s, p, self.object()))
                if self.said != ",":
                    break
                self.next()
            if self.said != ";":
                return
            while self.said == ";":
                self.next()
            if self.said in (".", "]"):
                return

    def object(self) -> str:
        kind, said = self.next()
        if kind == "iri":
            return T.iri(self.names.iri(said[1:-1]))
        if kind == "name":
            prefix, _, local = said.partition(":")
            if prefix not in self.names.prefixes:
                raise ValueError(f"unknown prefix {prefix!r}")
            return T.iri(self.names.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))
        if kind == "blank":
            return f"_:{self.scope}b{said[2:]}"
        if kind == "num":
            return T.literal(said, T.XSD + ("double" if "e" in said.lower() else "decimal" if "." in said else "integer"))
        if kind in ("text", "long"):
            body = plain(said[3:-3] if kind == "long" else said[1:-1])
            if self.kind == "at":
                return T.literal(body, lang=self.next()[1][1:])
            if self.said == "^^":
                self.next()
                return T.literal(body, self.object()[1:-1])
            return T.literal(body)
        if said in ("true", "false"):
            return T.literal(said, T.XSD + "boolean")
        if said in ("[", "("):
            self.depth += 1
            if self.depth > MOST_DEPTH:
                raise ValueError(f"brackets nested more than {MOST_DEPTH} deep")
            made = self.node() if said == "[" else self.list()
            self.depth -= 1
            return made
        _, _, line, column = self.tokens[self.at - 1]
        raise ValueError(f"unexpected {said!r} in line {line + 1}, column {column + 1}")

    def node(self) -> str:
        node = self.fresh()
        if self.said != "]":
            self.properties(node)
        self.next("]")
        return node

    def list(self) -> str:
        items = []
        while self.said != ")":
            items.append(self.object())
        self.next()
        head = NIL
        for item in reversed(items):
            node = self.fresh()
            self.out += [(node, FIRST, item), (node, REST, head)]
            head = node
        return head


def triples(lines: Iterable[str], scope: str = "", names: Names | None = None, line: int = 0) -> Iterator[tuple[str, str, str]]:
    """Triples of whole statements, each once per statement, as they are read."""
    names, lexer, splitter = names or Names(), Lexer(line=line), Splitter()
    for tokens in statements(lines, lexer, splitter):
        yield from dict.fromkeys(Statement(tokens, names, scope).triples())
    if lexer.quote:
        raise ValueError(f"the text that begins in line {lexer.begun[0] + 1} has no end")
    if splitter.open:
        raise ValueError(f"the statement that begins in line {splitter.open[0][2] + 1} has no end")


def lines_of(text: str) -> list[str]:
    return [x + "\n" for x in text.split("\n")]


def parse(text: str, scope: str = "") -> list[tuple[str, str, str]]:
    """Distinct triples of a document, in order."""
    return list(dict.fromkeys(triples(lines_of(text), scope)))
