"""Turtle in and out as table functions; also registered as the data source format "turtle".

`read` takes files of any size: Spark splits them at line ends. A first pass over the parts of split files
finds, for each of the three states that a line may begin in (outside, or inside either kind of triple
quotes), where statements end and which directives stand there; a scan of these few rows by file tells the
state, line number and prefixes each part really begins with. A second pass parses every part's own
statements; those that cross from one part to another are put together from their pieces.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import terms as T
from ..operators.closure import checkpointed
from .turtle_text import Lexer, Names, Splitter, Statement, Token, directive, lines_of, parse, statements, triples

#: Parts of split files whose states are broadcast (below a kilobyte each); more of them meet the lines by a shuffle.
MOST_PARTS = 1 << 16
PART = "graph_id string, start long"
SCAN = PART + ", quote string, leaves string, lines int, ends int, opens boolean, first string, last string, directives string, head string, tail string, tail_line int, tail_column int"
ENTRY = PART + ", quote string, line long, opened boolean, owner long, names string, names_after string"
TRIPLE = "graph_id string, s string, p string, o string"


def _scope(graph_id: str) -> str:
    return re.sub(r"\W", "", graph_id)[-40:]


def parsed(texts: DataFrame, permissive: bool = True) -> DataFrame:
    """graph_id, s, p, o, error of (graph_id, text) rows: a document that does not parse is one row with its error.

    With permissive=False it fails the job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows: list[tuple] = []
            for g, t in zip(f.graph_id, f.text, strict=True):
                try:
                    rows += [(g, *x, None) for x in parse(t or "", _scope(g))]
                except ValueError as e:
                    if not permissive:
                        raise ValueError(f"{g}: {e}") from e
                    rows.append((g, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["graph_id", "s", "p", "o", "error"])

    return texts.select(F.col("graph_id").cast("string").alias("graph_id"), "text").mapInPandas(run, "graph_id string, s string, p string, o string, error string")


def _lines(spark: SparkSession, path: str, named: str = "*.ttl") -> DataFrame:
    files = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).option("pathGlobFilter", named).text(path)
    of = lambda c: F.col(f"_metadata.{c}")
    whole = (of("file_block_start") == 0) & (of("file_block_length") >= of("file_size"))
    return files.select(of("file_path").alias("graph_id"), of("file_block_start").alias("start"), whole.alias("whole"), F.col("value"))


def _runs(frames: Iterable[pd.DataFrame], *columns: str) -> Iterator[tuple[tuple, Iterator[str]]]:
    """(file, start and the named columns of a part, its lines), for parts that follow each other in a task."""
    rows = (r for f in frames for r in zip(*(f[c] for c in ("graph_id", "start", *columns, "value")), strict=True))
    for key, part in groupby(rows, key=lambda r: r[:-1]):
        yield key, (f"{r[-1]}\n" for r in part)


class _Scan:
    """What a part holds if it begins within the given quotes (or outside them)."""

    def __init__(self, quote: str):
        self.lexer, self.splitter = Lexer(quote), Splitter()
        self.quote, self.ends, self.wrong = quote, 0, False
        self.first: list[Token] = []
        self.directives: list[list[str]] = []
        self.head: list[str] = []
        self.tail: list[str] = []
        self.at = (0, 0)

    def feed(self, text: str) -> None:
        if self.wrong:
            return
        line = self.lexer.line
        (self.tail if self.ends else self.head).append(text)
        try:
            for token in self.lexer.feed(text):
                if len(self.first) < 3:
                    self.first.append(token)
                for done in self.splitter.push(token):
                    cut = token[3] + (len(token[1]) if done[-1] is token else 0)  # a directive that cuts a statement off is outside it
                    if not self.ends:
                        self.head[-1] = text[:cut]
                    self.ends, self.at, self.tail = self.ends + 1, (line, cut), [text[cut:]]
                    if directive(done[0]):
                        self.directives.append([t[1] for t in done if t[:2] != ("sign", ".")])
        except ValueError:
            self.wrong = True

    def row(self) -> tuple:
        lexer, opened = self.lexer, self.splitter.open
        last = [t[1] for t in opened[:4]] if opened and directive(opened[0]) else []
        said = lambda x: json.dumps(x) if x else None
        opens = bool(opened or lexer.quote)
        tail = "".join(self.tail) if self.ends and opens else None
        return (self.quote, None if self.wrong else lexer.quote, lexer.line, self.ends, opens, said([t[1] for t in self.first]), said(last), said(self.directives), "".join(self.head), tail, *self.at)


def _scanned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for (graph, start), lines in _runs(frames):
        scans = [_Scan(q) for q in ("", '"""', "'''")]
        for text in lines:
            for scan in scans:
                scan.feed(text)
        yield pd.DataFrame([(graph, start, *s.row()) for s in scans], columns=[c.split()[0] for c in SCAN.split(", ")])


def _entries(scans: pd.DataFrame) -> pd.DataFrame:
    """For each part of one file, in order, what it really begins with, and the names in effect at its end."""
    rows, names = [], Names()
    quote, line, opened, owner, pending, wrong = "", 0, False, -1, [], False
    said_so = lambda: json.dumps([names.base, names.prefixes])
    for start, of in scans.sort_values(["start", "quote"]).groupby("start", sort=True):
        s = of[of["quote"] == quote].iloc[0]
        if wrong:  # a part before does not parse: the second pass tells where, and this one does not matter
            rows.append((s["graph_id"], start, quote, -1, opened, owner, said_so(), said_so()))
            continue
        if pending:
            pending = pending + json.loads(s["first"] or "[]")
            size = {"PREFIX": 3, "BASE": 2}[pending[0].removeprefix("@").upper()]
            if len(pending) >= size:
                names.take(pending[:size])
                pending = []
        begins = said_so()
        for said in json.loads(s["directives"] or "[]"):
            names.take(said)
        rows.append((s["graph_id"], start, quote, line, opened, owner, begins, said_so()))
        line, wrong = line + int(s["lines"]), s["leaves"] is None
        if s["ends"] or not opened:
            opened, owner, pending = bool(s["opens"]), start, json.loads(s["last"] or "[]")
        quote = s["leaves"] or ""
    return pd.DataFrame(rows, columns=[c.split()[0] for c in ENTRY.split(", ")])


def _own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Triples of the statements that begin and end within a part."""
    for (graph, start, whole, quote, line, opened, names), lines in _runs(frames, "whole", "quote", "line", "opened", "names"):
        if not whole and not names:
            raise ValueError(f"{graph}: no state of the part at byte {start}; files, or how they are split, changed while they were read")
        if not whole and line < 0:
            continue
        base, prefixes = json.loads(names) if names else ("", {})
        lexer, splitter, known, rows = Lexer(quote or "", 0 if whole else int(line)), Splitter(), Names(base, prefixes), []
        skip = not whole and bool(opened)
        try:
            for tokens in statements(lines, lexer, splitter):
                if skip:
                    skip = False
                    continue
                rows += dict.fromkeys(Statement(tokens, known, _scope(graph)).triples())
                if len(rows) > 20_000:
                    yield _frame(graph, rows)
                    rows = []
            if whole and (lexer.quote or splitter.open):
                raise ValueError("the last statement has no end")
        except ValueError as e:
            raise ValueError(f"{graph}: {e}") from e
        yield _frame(graph, rows)


def _frame(graph: str, rows: Iterable[tuple[str, str, str]]) -> pd.DataFrame:
    return pd.DataFrame([(graph, *x) for x in rows], columns=["graph_id", "s", "p", "o"])


def _crossing(pieces: pd.DataFrame) -> pd.DataFrame:
    """Triples of what begins in one part and ends in a later one."""
    pieces = pieces.sort_values("start")
    first = pieces.iloc[0]
    graph, (base, prefixes) = first["graph_id"], json.loads(first["names"])
    lines = lines_of(" " * int(first["column"]) + "".join(pieces["piece"]))
    try:
        return _frame(graph, dict.fromkeys(triples(lines, _scope(graph), Names(base, prefixes), int(first["line"]))))
    except ValueError as e:
        raise ValueError(f"{graph}: {e}") from e


def read(spark: SparkSession, path: str, named: str = "*.ttl") -> DataFrame:
    """graph_id, s, p, o: triples of all Turtle files of such names under a path; graph_id is the file.

    Files are split as spark.sql.files.maxPartitionBytes says; the triples, with the names of unlabelled
    nodes, do not depend on the splits. A statement's triples are distinct, a file's need not be. A file
    that does not parse fails the job and is named. One line is never split, and a statement is held whole.
    Empty files give no rows."""
    lines = _lines(spark, path, named)
    scans = checkpointed(lines.where(~F.col("whole")).select("graph_id", "start", "value").mapInPandas(_scanned, SCAN))
    entries = checkpointed(scans.drop("head", "tail").groupBy("graph_id").applyInPandas(_entries, ENTRY))
    parts = entries.count()
    if parts <= MOST_PARTS:
        told = lines.join(F.broadcast(entries), ["graph_id", "start"], "left")
    else:
        told = lines.withColumn("at", F.monotonically_increasing_id()).join(entries, ["graph_id", "start"], "left")
        told = told.repartition("graph_id", "start").sortWithinPartitions("graph_id", "start", "at")
    # a part's columns tell its lines from the next one's, so none of them may be null in pandas
    told = told.select("graph_id", "start", "whole", F.coalesce("quote", F.lit("")).alias("quote"), F.coalesce("line", F.lit(0).cast("long")).alias("line"), F.coalesce("opened", F.lit(False)).alias("opened"), F.coalesce("names", F.lit("")).alias("names"), "value")
    own = told.mapInPandas(_own, TRIPLE)
    return own.unionByName(_crossed(scans, entries)) if parts else own


def _crossed(scans: DataFrame, entries: DataFrame) -> DataFrame:
    """Triples of the statements that cross parts: the tail of one, any parts without an end, the head of another."""
    true = scans.join(entries.where("line >= 0"), ["graph_id", "start", "quote"])
    no = F.lit(None).cast("int")
    heads = true.where("opened").select("graph_id", "owner", "start", F.col("head").alias("piece"), no.cast("long").alias("line"), no.alias("column"), no.cast("string").alias("names"))
    begin = true.where(F.col("opens") & ((F.col("ends") > 0) | ~F.col("opened")))
    tails = begin.select("graph_id", F.col("start").alias("owner"), "start", F.coalesce("tail", "head").alias("piece"), (F.col("line") + F.col("tail_line")).alias("line"), F.col("tail_column").alias("column"), F.col("names_after").alias("names"))
    # a part's head goes before its tail, but they are of different statements: the owners differ
    return tails.union(heads).groupBy("graph_id", "owner").applyInPandas(_crossing, TRIPLE)


def subjects(triples: DataFrame) -> DataFrame:
    """graph_id, s, said: one Turtle statement for each subject of a graph, predicates and objects in order."""
    lines = triples.groupBy("graph_id", "s", "p").agg(F.array_join(F.array_sort(F.collect_set("o")), " , ").alias("os"))
    head = F.when(F.col("p") == T.TYPE, F.lit("a")).otherwise(F.col("p"))
    body = lines.groupBy("graph_id", "s").agg(F.array_sort(F.collect_list(F.struct((F.col("p") != T.TYPE).alias("k"), "p", F.concat_ws(" ", head, "os").alias("line")))).alias("ps"))
    return body.select("graph_id", "s", F.concat("s", F.lit(" "), F.array_join(F.expr("ps.line"), " ;\n    "), F.lit(" .\n")).alias("said"))


def written(triples: DataFrame) -> DataFrame:
    """graph_id, text: one document a graph in one row, subjects in order; for graphs of any size use write."""
    return subjects(triples).groupBy("graph_id").agg(F.array_join(F.expr("transform(array_sort(collect_list(struct(s, said))), x -> x.said)"), "\n").alias("text"))


def write(triples: DataFrame, path: str, long: bool = False) -> None:
    """Turtle files, a folder graph_id=... a graph, subjects dealt over files as Spark's partitions are.

    No prefixes are used, so each file is a document of its own; nodes without an address keep their labels,
    which are names within one file only, so write them (as read does) with labels that are unique. With
    long, literals of several lines stand in triple quotes, over lines as they are."""
    if long:
        rest = F.substring_index("o", '"', -1)  # a language or datatype holds no quote
        body = F.substring("o", F.lit(2), F.char_length("o") - F.char_length(rest) - 2)
        lines = F.regexp_replace(body, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
        whole = F.concat(F.lit('"""'), lines, F.lit('"""'), rest)
        triples = triples.withColumn("o", F.when(F.col("o").startswith('"') & (lines != body), whole).otherwise(F.col("o")))
    said = subjects(triples).select("graph_id", "said")
    said.write.mode("overwrite").partitionBy("graph_id").option("lineSep", "\n").text(path)


class TurtleSource(DataSource):
    """spark.read.format("turtle").option("text", ...).load(): triples of documents given as text."""

    @classmethod
    def name(cls) -> str:
        return "turtle"

    def schema(self) -> str:
        return TRIPLE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.text, self.graph = options.get("text", ""), options.get("graph", "g")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition):
        for s, p, o in parse(self.text, _scope(self.graph)):
            yield self.graph, s, p, o


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TurtleSource)
