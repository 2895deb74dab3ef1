"""Graph-pattern algebra evaluated to DataFrames: a column for each variable, null where unbound.

Patterns are bags over the set of triples; a closure path is a set. A filter that errs drops the row,
an IF whose condition errs is unbound: both are what nulls do here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from .closure import transitive
from .graph import Pattern, Store, Var, joined, told

TRUE, FALSE = (T.literal(x, T.XSD + "boolean") for x in ("true", "false"))


@dataclass(frozen=True)
class Path:
    """A property path: steps in sequence, each a choice of predicates, perhaps repeated one or more times."""

    s: Any
    steps: tuple[tuple[tuple[str, ...], bool], ...]  # (predicates, one or more)
    o: Any

    def variables(self) -> list[str]:
        return [t.name for t in (self.s, self.o) if isinstance(t, Var)]


@dataclass(frozen=True)
class Group:
    """Triple patterns and paths that are joined."""

    parts: tuple[Pattern | Path, ...]


@dataclass(frozen=True)
class Join:
    left: Any
    right: Any


@dataclass(frozen=True)
class LeftJoin:
    left: Any
    right: Any


@dataclass(frozen=True)
class Union:
    left: Any
    right: Any


@dataclass(frozen=True)
class Extend:
    of: Any
    name: str
    value: Any


@dataclass(frozen=True)
class Filter:
    of: Any
    test: Any


@dataclass(frozen=True)
class Minus:
    """Keeps what has no match in `group` (FILTER NOT EXISTS), or only what has (wanted)."""

    of: Any
    group: Any
    wanted: bool = False


@dataclass(frozen=True)
class Select:
    of: Any
    names: tuple[str, ...]
    order: tuple[tuple[str, bool], ...] = ()  # (variable, descending)


@dataclass(frozen=True)
class Call:
    """An expression: op and arguments; arguments are Call, Var, or a constant term."""

    op: str
    args: tuple[Any, ...] = ()


def evaluate(node: Any, store: Store, as_told: Callable[[str], Column] | None = None) -> DataFrame:
    """The node's rows; as_told is what to make of each column, null of null."""
    run = _Run(store)
    if as_told and isinstance(node, Select) and not node.order and isinstance(node.of, (Join, LeftJoin)):
        rows = run.together(node.of.left, node.of.right, "left" if isinstance(node.of, LeftJoin) else "inner", as_told)
        never = {c: F.lit(None).cast("string") for c in node.names if c not in rows.columns}
        return rows.withColumns(never).select(*[as_told(c).alias(c) if c in never else c for c in node.names])
    return told(run.frame(node), as_told)


def bindings(node: Any) -> tuple[frozenset[str], frozenset[str]]:
    """The variables that a node binds in every row, and those that it may leave unbound."""
    if isinstance(node, Group):
        return frozenset(v for q in node.parts for v in q.variables()), frozenset()
    if isinstance(node, (Join, LeftJoin, Union)):
        (a, maybe_a), (b, maybe_b) = bindings(node.left), bindings(node.right)
        sure = a & b if isinstance(node, Union) else a if isinstance(node, LeftJoin) else a | b
        return sure, (a | b | maybe_a | maybe_b) - sure
    if isinstance(node, Extend):
        sure, maybe = bindings(node.of)
        return sure, maybe | {node.name}
    sure, maybe = bindings(node.of)
    if isinstance(node, Select):
        return sure & set(node.names), frozenset(node.names) - sure
    return sure, maybe


class _Run:
    def __init__(self, store: Store):
        self.store, self.fresh = store, count()
        self.unbound: frozenset[str] = frozenset()  # in the rows that a test or value is made for

    def frame(self, node: Any) -> DataFrame:
        return getattr(self, f"_{type(node).__name__.lower()}")(node)

    def together(self, left: Any, right: Any, how: str = "inner", as_told: Callable[[str], Column] | None = None) -> DataFrame:
        return joined(self.frame(left), self.frame(right), how, bindings(left)[1], bindings(right)[1], as_told)

    def _group(self, g: Group) -> DataFrame:
        plain = [q for q in g.parts if isinstance(q, Pattern)]
        frames = [self.store.bgp(plain)] if plain else []
        frames += [self.path(q) for q in g.parts if isinstance(q, Path)]
        out, todo = frames[0], frames[1:]
        while todo:
            nxt = next((f for f in todo if set(f.columns) & set(out.columns)), todo[0])
            todo.remove(nxt)
            out = joined(out, nxt)
        return out

    def path(self, q: Path) -> DataFrame:
        mids = [q.s, *[Var(f"_path{next(self.fresh)}") for _ in q.steps[1:]], q.o]
        frames = []
        for (predicates, more), a, b in zip(q.steps, mids[:-1], mids[1:], strict=True):
            x, y = (t if isinstance(t, Var) else Var(f"_end{next(self.fresh)}") for t in (a, b))
            edges = reduce(DataFrame.unionByName, [self.store.scan(Pattern(Var("src"), p, Var("dst"))) for p in predicates])
            rows = (transitive(edges) if more else edges).where(reduce(lambda m, n: m & n, [F.col(c) == t for c, t in (("src", a), ("dst", b)) if not isinstance(t, Var)], F.lit(True)))
            frames.append(rows.where("src = dst").select(F.col("src").alias(x.name)) if x.name == y.name else rows.select(F.col("src").alias(x.name), F.col("dst").alias(y.name)))
        out = reduce(joined, frames)
        return out.select(*[c for c in out.columns if not c.startswith(("_path", "_end"))])

    def _join(self, n: Join) -> DataFrame:
        return self.together(n.left, n.right)

    def _leftjoin(self, n: LeftJoin) -> DataFrame:
        return self.together(n.left, n.right, "left")

    def _union(self, n: Union) -> DataFrame:
        return self.frame(n.left).unionByName(self.frame(n.right), allowMissingColumns=True)

    def _minus(self, n: Minus) -> DataFrame:
        return self.together(n.of, n.group, "left_semi" if n.wanted else "left_anti")

    def _filter(self, n: Filter) -> DataFrame:
        df = self.frame(n.of)
        columns, self.unbound = df.columns, bindings(n.of)[1]
        df, test = self.test(df, n.test)
        return df.where(test).select(*columns)

    def _extend(self, n: Extend) -> DataFrame:
        df = self.frame(n.of)
        columns, self.unbound = df.columns, bindings(n.of)[1]
        df, value = self.value(df, n.value)
        return df.select(*columns, value.alias(n.name))

    def _select(self, n: Select) -> DataFrame:
        df = self.frame(n.of)
        keys: list[Column] = []
        for name, down in n.order:
            for k in T.order_keys(F.col(name)):
                keys.append(k)
            if down:
                keys = [*keys[:-4], *[c.desc() for c in (T.kind_rank(F.col(name)), T.lexical(F.col(name)).try_cast("double"), T.lexical(F.col(name)), F.col(name))]]
        df = df.orderBy(*keys) if keys else df
        return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in n.names])

    def test(self, df: DataFrame, e: Any) -> tuple[DataFrame, Column]:
        """A boolean column for an expression; null where it errs."""
        op = e.op if isinstance(e, Call) else None
        if op in ("or", "and"):
            df, a = self.test(df, e.args[0])
            df, b = self.test(df, e.args[1])
            return df, a | b if op == "or" else a & b
        if op == "not":
            df, a = self.test(df, e.args[0])
            return df, ~a
        if op == "bound":
            name = e.args[0].name
            return df, F.col(name).isNotNull() if name in df.columns else F.lit(False)
        if op in ("=", "!="):
            df, a = self.value(df, e.args[0])
            df, b = self.value(df, e.args[1])
            return df, a == b if op == "=" else a != b
        if op == "regex":
            df, text = self.value(df, e.args[0])
            pattern, flags = e.args[1], e.args[2] if len(e.args) > 2 else '""'
            prefix = f"(?{flags[1:-1]})" if flags != '""' else ""
            return df, T.lexical(text).rlike(prefix + pattern[1:-1].replace('\\"', '"').replace("\\\\", "\\"))
        if op in ("exists", "not exists"):
            here = self.unbound
            found = self.frame(e.args[0])
            self.unbound = here
            shared = [c for c in df.columns if c in found.columns]
            there = bindings(e.args[0])[1]
            loose = (here | there) & set(shared)
            mark = f"_found{next(self.fresh)}"
            if loose or not shared:
                some = found.select(*shared).distinct() if shared else found.limit(1)
                hits, misses = (joined(df, some, how, here, there).withColumn(mark, F.lit(how == "left_semi")) for how in ("left_semi", "left_anti"))
                df = hits.unionByName(misses)
            else:
                df = df.join(found.select(*shared).distinct().withColumn(mark, F.lit(True)), shared, "left")
            hit = F.coalesce(F.col(mark), F.lit(False))
            return df, hit if op == "exists" else ~hit
        df, v = self.value(df, e)
        return df, F.when(v == TRUE, True).when(v == FALSE, False)

    def value(self, df: DataFrame, e: Any) -> tuple[DataFrame, Column]:
        """A term column for an expression."""
        if isinstance(e, Var):
            return df, F.col(e.name) if e.name in df.columns else F.lit(None).cast("string")
        if isinstance(e, str):
            return df, F.lit(e)
        if e.op == "if":
            df, c = self.test(df, e.args[0])
            df, a = self.value(df, e.args[1])
            df, b = self.value(df, e.args[2])
            return df, F.when(c, a).when(~c, b)
        if e.op == "coalesce":
            values = []
            for x in e.args:
                df, v = self.value(df, x)
                values.append(v)
            return df, F.coalesce(*values)
        if e.op == "str":
            df, v = self.value(df, e.args[0])
            return df, T.literal_of(T.lexical(v))
        df, c = self.test(df, e)
        return df, F.when(c, TRUE).when(~c, FALSE)
