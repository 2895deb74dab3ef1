"""Graphs as DataFrames: triples(graph_id, s, p, o) of canonical terms, a set per graph.

TripleStore answers patterns from such a DataFrame. TableStore answers the same patterns from ordinary
tables by a direct mapping (row: subject <table/key>, column: predicate <table#column>, foreign key:
IRI object), without making triples; patterns on one subject variable become one scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from .closure import checkpointed

#: Rows of the smaller side that are paired at once where a join gives all pairs.
BLOCK_ROWS = 256
TRIPLE_SCHEMA = "graph_id string, s string, p string, o string"


def as_set(triples: DataFrame) -> DataFrame:
    return triples.dropDuplicates(["graph_id", "s", "p", "o"])


def add(graph: DataFrame, more: DataFrame) -> DataFrame:
    """Insert if absent."""
    return as_set(graph.unionByName(more))


def with_schema(graph: DataFrame, schema: DataFrame, ontology: str, imports: tuple[str, ...] = ()) -> DataFrame:
    """Every graph with the schema's triples and an ontology header."""
    ids = graph.select("graph_id").distinct()
    head = [(T.iri(ontology), T.TYPE, T.iri(T.OWL + "Ontology")), *((T.iri(ontology), T.iri(T.OWL + "imports"), T.iri(i)) for i in imports)]
    rows = F.explode(F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip("spo", h, strict=True)]) for h in head]))
    heads = ids.select("graph_id", rows.alias("t")).select("graph_id", "t.s", "t.p", "t.o")
    body = schema.select("s", "p", "o").distinct()
    per_graph = ids.withColumn("_", F.lit(1)).join(body.withColumn("_", F.lit(1)), "_").select("graph_id", "s", "p", "o")
    return as_set(graph.unionByName(heads).unionByName(per_graph))


def match(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    bound = [F.col(c) == v for c, v in (("s", s), ("p", p), ("o", o)) if v is not None]
    return triples.where(reduce(lambda a, b: a & b, bound)) if bound else triples


def subjects(triples: DataFrame, p: str, o: str) -> DataFrame:
    return match(triples, p=p, o=o).select("graph_id", "s").distinct()


def objects(triples: DataFrame, p: str, s: str | None = None) -> DataFrame:
    """graph_id, s, o of a property, of one subject if given."""
    return match(triples, s=s, p=p).select("graph_id", "s", "o")


def holds(rows: DataFrame, triples: DataFrame, p: str, o: str, name: str = "holds") -> DataFrame:
    """The rows (graph_id, s, ...) with a column that tells whether their graph has the triple (s, p, o)."""
    found = subjects(triples, p, o).withColumn("_found", F.lit(True))
    return rows.join(found, ["graph_id", "s"], "left").withColumn(name, F.coalesce("_found", F.lit(False))).drop("_found")


def first_value(triples: DataFrame, p: str) -> DataFrame:
    """graph_id, s, value: the least object's text, so that several give the same one on every run."""
    return match(triples, p=p).groupBy("graph_id", "s").agg(T.lexical(F.min("o")).alias("value"))


def config_value(triples: DataFrame, holds: str, key: str, value: str, wanted: str) -> DataFrame:
    """graph_id, s, value through a node that s `holds` and whose `key` is `wanted`."""
    a = match(triples, p=holds).select("graph_id", "s", F.col("o").alias("node"))
    k = match(triples, p=key, o=wanted).select("graph_id", F.col("s").alias("node"))
    v = match(triples, p=value).select("graph_id", F.col("s").alias("node"), "o")
    return a.join(k, ["graph_id", "node"]).join(v, ["graph_id", "node"]).groupBy("graph_id", "s").agg(T.lexical(F.min("o")).alias("value"))


@dataclass(frozen=True)
class Var:
    name: str


Term = str | Var


@dataclass(frozen=True)
class Pattern:
    s: Term
    p: Term
    o: Term

    def variables(self) -> list[str]:
        return list(dict.fromkeys(t.name for t in (self.s, self.p, self.o) if isinstance(t, Var)))


class Store:
    def scan(self, pattern: Pattern) -> DataFrame:
        raise NotImplementedError

    def order(self, patterns: list[Pattern]) -> list[Pattern]:
        """Bound positions first, then patterns that share a variable with those before."""
        bound = lambda q: sum(not isinstance(t, Var) for t in (q.s, q.p, q.o))
        rest, out, seen = sorted(patterns, key=lambda q: -bound(q)), [], set()
        while rest:
            nxt = next((q for q in rest if seen & set(q.variables())), rest[0]) if seen else rest[0]
            rest.remove(nxt)
            out.append(nxt)
            seen |= set(nxt.variables())
        return out

    def bgp(self, patterns: list[Pattern]) -> DataFrame:
        """Join of the patterns on their shared variables: a bag over the set of triples."""
        return reduce(joined, [self.scan(q) for q in self.order(patterns)])


def told(df: DataFrame, as_told: Callable[[str], Column] | None) -> DataFrame:
    """What is made of each column, if anything."""
    return df.select(*[as_told(c).alias(c) for c in df.columns]) if as_told else df


def joined(a: DataFrame, b: DataFrame, how: str = "inner", unbound: frozenset[str] = frozenset(), unbound_right: frozenset[str] = frozenset(), as_told: Callable[[str], Column] | None = None) -> DataFrame:
    """Join on the shared variables. One of `unbound` may be null in a, and then is compatible with any value; one of
    unbound_right may be so in b.

    Rows of a that bind a variable and rows that do not are joined apart, each by equality. Without a shared
    variable the result is that of all pairs: what such a query asks for. as_told is what to make of each column of
    the result, null of null; of all pairs it is made before rows are paired, once a row and not once a pair."""
    shared = [c for c in a.columns if c in b.columns]
    if not (unbound | unbound_right) & set(shared):
        if shared or how in ("left_semi", "left_anti"):
            return told(a.join(b, shared or None, how), as_told)
        if how == "inner":
            return told(a, as_told).crossJoin(told(b, as_told))
        # all pairs, dealt out by the larger side; a's rows alone only if b has none
        rows = checkpointed(told(a, as_told))  # its true size tells whether it can be broadcast
        alone = rows.join(b.select(F.lit(1).alias("_some")).limit(1), None, "left_anti")
        # blocks of them are paired and then taken apart, which takes less than half the time of pairing each
        block = F.floor(F.monotonically_increasing_id() / BLOCK_ROWS)
        blocks = rows.select(block.alias("_block"), F.struct(*rows.columns).alias("_row")).groupBy("_block").agg(F.collect_list("_row").alias("_rows")).drop("_block")
        b = told(b, as_told)
        return blocks.crossJoin(b).select(F.inline("_rows"), *b.columns).unionByName(alone, allowMissingColumns=True)
    if not unbound_right & set(shared):
        c = next(c for c in shared if c in unbound)
        names = a.columns if how in ("left_semi", "left_anti") else [*a.columns, *(x for x in b.columns if x not in a.columns)]
        bound = joined(a.where(F.col(c).isNotNull()), b, how, unbound - {c}, as_told=as_told)
        free = joined(a.where(F.col(c).isNull()).drop(c), b, how, unbound - {c}, as_told=as_told)
        free = free if c in free.columns else free.withColumn(c, F.lit(None).cast(bound.schema[c].dataType))
        return bound.select(*names).unionByName(free.select(*names))
    unbound = unbound | unbound_right
    x, y = a.alias("_a"), b.alias("_b")
    tests = []
    for c in shared:
        p, q = F.col(f"_a.`{c}`"), F.col(f"_b.`{c}`")
        tests.append((p == q) | p.isNull() | q.isNull() if c in unbound else p == q)
    both = x.join(y, reduce(lambda m, n: m & n, tests), how)
    if how in ("left_semi", "left_anti"):
        return told(both.select(*[F.col(f"_a.`{c}`") for c in a.columns]), as_told)
    own = [F.coalesce(F.col(f"_a.`{c}`"), F.col(f"_b.`{c}`")).alias(c) if c in shared else F.col(f"_a.`{c}`") for c in a.columns]
    return told(both.select(*own, *[F.col(f"_b.`{c}`") for c in b.columns if c not in shared]), as_told)


def _bind(rows: DataFrame, pattern: Pattern) -> DataFrame:
    """Columns s, p, o filtered by the constants and named by the variables; a repeated variable must agree."""
    columns: dict[str, Column] = {}
    for c, t in (("s", pattern.s), ("p", pattern.p), ("o", pattern.o)):
        if isinstance(t, Var):
            if t.name in columns:
                rows = rows.where(F.col(c) == columns[t.name])
            else:
                columns[t.name] = F.col(c)
        else:
            rows = rows.where(F.col(c) == t)
    return rows.select(*[c.alias(n) for n, c in columns.items()]) if columns else rows.select(F.lit(1).alias("_"))


@dataclass
class TripleStore(Store):
    """triples: s, p, o of one graph, a set. Stored by predicate, a pattern reads only its own files."""

    triples: DataFrame
    #: Predicates with at most one object a subject: star patterns over them are one aggregation.
    functional: frozenset[str] = frozenset()

    def scan(self, pattern: Pattern) -> DataFrame:
        return _bind(self.triples, pattern)

    def bgp(self, patterns: list[Pattern]) -> DataFrame:
        stars: dict[str, list[Pattern]] = {}
        for q in patterns:
            if isinstance(q.s, Var) and isinstance(q.p, str) and isinstance(q.o, Var) and q.p in self.functional and q.o.name != q.s.name:
                stars.setdefault(q.s.name, []).append(q)
        parts, used = [], []
        for s, group in stars.items():
            if len(group) > 1 and len({q.p for q in group}) == len({q.o.name for q in group}) == len(group):
                rows = self.triples.where(F.col("p").isin(*[q.p for q in group])).groupBy(F.col("s").alias(s)).agg(*[F.max(F.when(F.col("p") == q.p, F.col("o"))).alias(q.o.name) for q in group])
                parts.append(rows.dropna(subset=[q.o.name for q in group]))
                used += group
        rest = [q for q in patterns if q not in used]
        frames = parts + [self.scan(q) for q in self.order(rest)]
        out, todo = frames[0], frames[1:]
        while todo:
            nxt = next((f for f in todo if set(f.columns) & set(out.columns)), todo[0])
            todo.remove(nxt)
            out = joined(out, nxt)
        return out


@dataclass
class Mapping:
    """How a table's rows are subjects: key columns, foreign keys (column: table), literal columns by type."""

    key: tuple[str, ...]
    foreign: dict[str, str] = field(default_factory=dict)
    skip: tuple[str, ...] = ()


XSD_OF = {"bigint": "integer", "int": "integer", "smallint": "integer", "double": "double", "float": "double", "boolean": "boolean", "timestamp": "dateTime", "date": "date"}


@dataclass
class TableStore(Store):
    tables: dict[str, DataFrame]
    mappings: dict[str, Mapping]
    base: str = ""

    def subject(self, table: str) -> Column:
        parts: list[Column | str] = [f"{self.base}{table}/"]
        for k, c in enumerate(self.mappings[table].key):
            parts += ["/", F.col(c)] if k else [F.col(c)]
        return T.iri_of(*parts)

    def value(self, table: str, column: str) -> Column:
        m = self.mappings[table]
        if column in m.foreign:
            return T.iri_of(f"{self.base}{m.foreign[column]}/", F.col(column))
        kind = dict(self.tables[table].dtypes)[column]
        return T.literal_of(F.col(column), T.XSD + XSD_OF[kind] if kind in XSD_OF else "")

    def predicate(self, table: str, column: str) -> str:
        return f"<{self.base}{table}#{column}>"

    def _place(self, p: Term) -> tuple[str, str] | None:
        if isinstance(p, str) and p.startswith(f"<{self.base}") and "#" in p:
            table, _, column = p[1 + len(self.base) : -1].rpartition("#")
            if table in self.tables and column in self.tables[table].columns:
                return table, column
        return None

    def triples(self, table: str, rows: DataFrame | None = None) -> DataFrame:
        """All triples of a table, or of some of its rows; null cells have none."""
        m = self.mappings[table]
        columns = [c for c, t in self.tables[table].dtypes if c not in m.skip and not t.startswith(("array", "map", "struct"))]
        pairs = [F.struct(F.lit(T.TYPE).alias("p"), F.lit(f"<{self.base}{table}>").alias("o"))]
        pairs += [F.struct(F.lit(self.predicate(table, c)).alias("p"), self.value(table, c).alias("o")) for c in columns]
        rows = (self.tables[table] if rows is None else rows).select(self.subject(table).alias("s"), F.explode(F.array(*pairs)).alias("t"))
        return rows.select("s", "t.p", "t.o").where("o is not null")

    def materialised(self, *names: str) -> DataFrame:
        """The set of all triples of the tables.

        A row whose subject no other row has gives triples that nothing repeats, so only the others are compared."""
        parts = []
        for n in names or tuple(self.tables):
            key = F.xxhash64(self.subject(n))
            twice = checkpointed(self.tables[n].groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key"))
            if twice.isEmpty():
                parts.append(self.triples(n))
                continue
            keyed = self.tables[n].withColumn("_key", key)
            alone, several = (keyed.join(twice, "_key", how).drop("_key") for how in ("left_anti", "left_semi"))
            parts += [self.triples(n, alone), self.triples(n, several).distinct()]
        return reduce(DataFrame.unionByName, parts)

    def scan(self, pattern: Pattern) -> DataFrame:
        place = self._place(pattern.p)
        if place:
            table, column = place
            rows = self.tables[table].where(F.col(column).isNotNull()).select(self.subject(table).alias("s"), F.lit(pattern.p).alias("p"), self.value(table, column).alias("o"))
            return _bind(rows, pattern)
        if pattern.p == T.TYPE and isinstance(pattern.o, str):
            table = pattern.o[1 + len(self.base) : -1]
            if table in self.tables:
                return _bind(self.tables[table].select(self.subject(table).alias("s"), F.lit(T.TYPE).alias("p"), F.lit(pattern.o).alias("o")), pattern)
        return _bind(self.materialised(), pattern)

    def bgp(self, patterns: list[Pattern]) -> DataFrame:
        """Patterns over columns of one table with one subject variable are one scan of that table."""
        groups: dict[tuple, list[Pattern]] = {}
        for k, q in enumerate(patterns):
            place = self._place(q.p)
            if place is None and q.p == T.TYPE and isinstance(q.o, str) and q.o[1 + len(self.base) : -1] in self.tables:
                place = (q.o[1 + len(self.base) : -1], "")
            groups.setdefault((place[0], q.s) if place and isinstance(q.s, Var) else (k,), []).append(q)
        frames = []
        for key, group in groups.items():
            if len(key) == 1:
                frames.append(self.scan(group[0]))
                continue
            table, s = key
            rows, columns = self.tables[table], {s.name: self.subject(table)}
            for q in group:
                if q.p == T.TYPE:
                    continue
                column = self._place(q.p)[1]
                value = self.value(table, column)
                rows = rows.where(F.col(column).isNotNull())
                if isinstance(q.o, Var) and q.o.name not in columns:
                    columns[q.o.name] = value
                else:
                    rows = rows.where(value == (columns[q.o.name] if isinstance(q.o, Var) else F.lit(q.o)))
            frames.append(rows.select(*[c.alias(n) for n, c in columns.items()]))
        out, todo = frames[0], frames[1:]
        while todo:
            nxt = next((f for f in todo if set(f.columns) & set(out.columns)), todo[0])
            todo.remove(nxt)
            out = joined(out, nxt)
        return out
