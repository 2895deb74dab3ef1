"""Tables as text and back: documents as Turtle files, conversations as Python sources of state graphs.

Each query writes or makes sources out of a whole table, reads them by the library's own scans, and has a
plain SQL twin over the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..operators.closure import checkpointed, shared_folder
from ..operators.extract import python_text
from ..operators.graph import TripleStore
from ..operators.recover import Recovery
from ..operators.symbols import kept_facts
from ..sources import turtle
from .suite import ask

DOC = "http://example.org/document#"


def document_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id, s, p, o of all documents; a null gives no triple."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    fact = lambda name, o: F.struct(F.lit(T.iri(DOC + name)).alias("p"), o.alias("o"))
    told = [fact(c, T.literal_of(F.col(c))) for c in ("text", "lang", "source")] + [fact("n_chars", T.literal_of(F.col("n_chars"), T.XSD + "integer"))]
    kind = F.struct(F.lit(T.TYPE).alias("p"), F.lit(T.iri(DOC + "Document")).alias("o"))
    rows = docs.select(F.lit("documents").alias("graph_id"), T.iri_of("http://example.org/document/", F.col("doc_id")).alias("s"), F.inline(F.array(kind, *told)))
    return rows.where("o is not null")


def turtle_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as Turtle files, texts over many lines as they stand, read in splits, and asked for again."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    turtle.write(document_triples(spark, sf_dir), folder, long=True)
    store = TripleStore(checkpointed(turtle.read(spark, folder, "*.txt").select("s", "p", "o")))
    asked = f"PREFIX d: <{DOC}> SELECT ?s ?text ?lang ?source ?n WHERE {{ ?s a d:Document ; d:text ?text . OPTIONAL {{ ?s d:lang ?lang }} OPTIONAL {{ ?s d:source ?source }} OPTIONAL {{ ?s d:n_chars ?n }} }}"
    rows = ask(asked, store, n="long")
    return rows.select(F.substring_index("s", "/", -1).cast("long").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang", "source", F.col("n").alias("n_chars"))


def conversation_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """system_id, path, source: each conversation as a program of three files, a node a turn."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    turn, said = F.col("turn").cast("string"), python_text(F.col("text"))
    prompt = F.concat(F.lit("P"), turn, F.lit(' = "'), said, F.lit('"\n'))
    node = F.format_string('def n%s(state):\n    "Says it."\n    out = armed.invoke([SystemMessage(content=P%s), HumanMessage(content="Turn " + P%s)])\n    return {"out%s": out}\n', turn, turn, turn, turn)
    add = F.format_string('g.add_node("s%s", n%s)\ng.add_edge("s%s", "s%s")\n', turn, turn, turn, (F.col("turn") + 1).cast("string"))
    lines = lambda c: F.array_join(F.expr(f"transform(array_sort(collect_list(struct(turn, {c}))), x -> x.{c})"), "")
    # a conversation has few turns; what is collected here is the program that they make
    made = turns.select("conv_id", "turn", prompt.alias("prompt"), node.alias("node"), add.alias("added")).groupBy("conv_id").agg(*[lines(c).alias(c) for c in ("prompt", "node", "added")])
    model = F.format_string('from prompts import *\nfrom langchain_openai import ChatOpenAI\nbase = ChatOpenAI(model="m" + "%s")\nkit = [look, count]\narmed = base.bind_tools(kit)\n', (F.col("conv_id") % 7).cast("string"))
    stop = F.when(F.col("conv_id") % 2 == 0, F.lit('app = g.compile(checkpointer=MemorySaver(), interrupt_before=["s1"])\n')).otherwise(F.lit("app = g.compile()\n"))
    file = lambda path, *text: F.struct(F.lit(path).alias("path"), F.concat(*text).alias("source"))
    files = F.array(file("prompts.py", F.col("prompt")), file("nodes.py", model, F.col("node")), file("main.py", F.lit("from nodes import *\nfrom langgraph.graph import StateGraph\ng = StateGraph(dict)\n"), F.col("added"), stop))
    return made.select(F.concat(F.lit("c"), "conv_id").alias("system_id"), F.inline(files))


def recovered_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models, tools, prompts, checkpoints and tasks of state graphs, found across the files of each program."""
    made = Recovery(kept_facts(conversation_sources(spark, sf_dir), strict=True)).state_graphs()
    agents = made["agents"].select("system_id", "agent_key", "goal", F.md5(F.col("backstory").cast("binary")).alias("prompt_md5"), "llm", F.array_join("tools", ",").alias("tools"), "human_input")
    tasks = made["tasks"].select("system_id", "agent_key", F.md5(F.col("description").cast("binary")).alias("task_md5"), "expected_output")
    return agents.join(tasks, ["system_id", "agent_key"])


QUERIES = {"turtle_documents": turtle_documents, "recovered_nodes": recovered_nodes}

ORACLES = {
    "turtle_documents": "SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars FROM documents WHERE text IS NOT NULL",
    "recovered_nodes": (
        "SELECT 'c' || conv_id AS system_id, 's' || turn AS agent_key, 'Says it.' AS goal, md5(coalesce(text, '')) AS prompt_md5, 'm' || (conv_id % 7) AS llm, 'count,look' AS tools, "
        "conv_id % 2 = 0 AND turn = 1 AS human_input, md5('Turn ' || coalesce(text, '')) AS task_md5, 'out' || turn AS expected_output FROM conversations"
    ),
}
