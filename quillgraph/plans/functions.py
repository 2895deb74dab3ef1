"""Functions and smaller operators over whole tables, each with its plain SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import terms as T
from ..operators import align, compare, graph, workflow
from ..sources import trees


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def name_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as snake case, class names, folded names and objects as they are shown."""
    p = _table(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat_ws("_", "p_brand", F.initcap("p_type")).alias("mixed"))
    return p.select("p_partkey", T.snake(F.col("mixed")).alias("snake"), T.class_name(F.col("mixed")).alias("class_name"), T.folded_name(F.col("mixed")).alias("folded"), T.shown(T.literal_of(F.col("p_name"))).alias("literal"), T.shown(T.iri_of("http://e/part#", F.col("p_partkey"))).alias("iri"), T.truthy(F.col("p_name")).alias("truthy"))


def first_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts cut at their first full stop and space."""
    cut = T.goal_and_story(F.coalesce("text", F.lit("")))
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(cut["goal"].cast("binary")).alias("goal_md5"), F.char_length(cut["story"]).cast("long").alias("story_chars"))


def corpora_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which corpora are ready, of paths made of orders: a family a customer, a framework a priority."""
    last = F.when(F.col("o_orderkey") % 3 == 0, "source_files/main.py").when(F.col("o_orderkey") % 3 == 1, "ground_truth.ttl").otherwise("README.md")
    return trees.corpora(_table(spark, sf_dir, "orders").select(F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderpriority", last).alias("path")))


def unused_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no triple of a line names as its predicate."""
    names = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("name"))
    lines = _table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(T.iri_of("http://e/part/", F.col("l_partkey")).alias("p"))
    return compare.unused(names, lines)


def inserted_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of lines added to those of other lines: what is there already is not added."""
    lines = _table(spark, sf_dir, "lineitem")
    triples = lambda rows: rows.select(F.lit("g").alias("graph_id"), T.iri_of("http://e/part/", F.col("l_partkey")).alias("s"), F.lit("<http://e/from>").alias("p"), T.iri_of("http://e/supplier/", F.col("l_suppkey")).alias("o"))
    return graph.add(triples(lines.where("l_returnflag = 'R'")), triples(lines.where("l_returnflag <> 'R'"))).select("s", "o")


def recorded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation against the next, as recorded runs of a program and their outputs."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    c = _table(spark, sf_dir, "conversations")
    n = c.select("conv_id", "turn", "role", "text", F.lead("turn").over(by).alias("t2"), F.lead("role").over(by).alias("r2"), F.lead("text").over(by).alias("x2")).where("t2 is not null")
    runs = n.select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("pair_id"), (F.col("role") == "user").alias("ref_ok"), (F.col("r2") == "user").alias("cand_ok"),
        F.concat("role", F.lit(": x")).alias("ref_error"), F.concat("r2", F.lit(": y")).alias("cand_error"), F.col("text").alias("ref_stdout"), F.col("x2").alias("cand_stdout"),
        (F.col("turn") + 1).cast("double").alias("ref_seconds"), (F.col("t2") + 1).cast("double").alias("cand_seconds"),
    )
    return compare.execution_agreement(runs)


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of even and of odd documents as elements of a type a language, with the weighted score."""
    elements = _table(spark, sf_dir, "documents").where("source is not null and lang is not null").select(F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("graph_id"), F.col("lang").alias("type"), F.upper("source").alias("key"))
    pairs = spark.createDataFrame([("p", "even", "odd")], "pair_id string, ref_id string, cand_id string")
    rows = compare.element_coverage(elements, pairs)
    return rows.select("type", "precision", "recall", "f1", F.round(compare.weighted_coverage(F.col("f1"), F.col("recall"), F.col("precision")) * 1000).cast("long").alias("weighted"))


def listened_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between turns that listen for a role or for the turn before, by label."""
    c = _table(spark, sf_dir, "conversations")
    name = F.concat(F.lit("s"), F.col("turn").cast("string"))
    before = F.concat(F.lit("s"), (F.col("turn") - 1).cast("string"))
    none = F.array().cast("array<string>")
    steps = c.select(F.col("conv_id").cast("string").alias("flow"), name.alias("name"), F.when(F.col("turn") == 0, none).when(F.col("turn") % 2 == 1, F.array(before)).otherwise(F.array(F.lit("go"))).alias("dependencies"), F.when(F.col("turn") % 2 == 1, F.array(F.lit("go"))).otherwise(none).alias("return_values"), none.alias("outgoing"))
    return workflow.resolved_edges(steps)


def turn_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How turns coordinate: assistants are agents, users tools, and every third turn leads on by a condition."""
    c = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("flow"), "turn", "role")
    steps = c.select("flow", F.col("turn").cast("string").alias("name"), F.when(F.col("role") == "assistant", "agent").when(F.col("role") == "user", "tool").otherwise("other").alias("kind"), ((F.col("flow").cast("long") % 5 == 0) & (F.col("turn") == 1)).alias("dynamic"))
    last = F.max("turn").over(Window.partitionBy("flow"))
    step = c.withColumn("last", last)
    on = step.select("flow", F.col("turn").cast("string").alias("src"), F.when(F.col("turn") == F.col("last"), "END").otherwise((F.col("turn") + 1).cast("string")).alias("dst"), (F.col("turn") % 3 == 1).alias("conditional"))
    back = step.where("turn % 3 = 1 and turn >= 2").select("flow", F.col("turn").cast("string").alias("src"), (F.col("turn") - 2).cast("string").alias("dst"), F.lit(True).alias("conditional"))
    return workflow.topology(steps, on.union(back))


def matched_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched names and their mean score by block: the best line of each order by price, matched greedily."""
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("block"), F.col("l_orderkey").cast("string").alias("ref"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("cand"), F.round(F.col("l_discount"), 3).cast("double").alias("score"))
    return align.class_means(lines)


QUERIES = {f.__name__: f for f in (name_functions, first_sentences, corpora_listing, unused_parts, inserted_triples, recorded_runs, coverage, listened_edges, turn_topology, matched_means)}

_MIXED = "p_brand || '_' || array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
_TOKENS = "list_distinct(list_transform(list_filter(regexp_split_to_array(coalesce({0}, ''), '\\s+'), lambda w: w <> ''), lambda w: regexp_replace(w, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')))"
ORACLES = {
    "name_functions": (
        f"SELECT p_partkey, translate(lower(regexp_replace(m, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), ' -', '__') AS snake, "
        "CASE WHEN regexp_full_match(m, '[A-Z][A-Za-z0-9]*') THEN m ELSE array_to_string(list_transform(list_filter(regexp_split_to_array(m, '[_\\-\\s.]+'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), '') END AS class_name, "
        "lower(trim(regexp_replace(replace(m, '_', ' '), '\\s+', ' ', 'g'))) AS folded, '\"' || p_name || '\"' AS literal, p_partkey::VARCHAR AS iri, coalesce(lower(p_name) IN ('true', '1', 'yes'), false) AS truthy "
        f"FROM (SELECT p_partkey, p_name, {_MIXED} AS m FROM part)"
    ),
    "first_sentences": "SELECT doc_id, md5(CASE WHEN k > 0 THEN t[1:k] ELSE t END) AS goal_md5, CASE WHEN k > 0 THEN length(t) - k - 1 ELSE 0 END::BIGINT AS story_chars FROM (SELECT doc_id, coalesce(text, '') AS t, instr(coalesce(text, ''), '. ') AS k FROM documents)",
    "corpora_listing": "SELECT o_custkey::VARCHAR AS family, o_orderpriority AS framework, bool_or(o_orderkey % 3 = 0) AS has_source, bool_or(o_orderkey % 3 = 1) AS has_truth, bool_or(o_orderkey % 3 = 0) AND bool_or(o_orderkey % 3 = 1) AS ready FROM orders GROUP BY 1, 2",
    "unused_parts": "SELECT p_partkey::VARCHAR AS name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48 AND l_partkey IS NOT NULL)",
    "inserted_triples": "SELECT DISTINCT '<http://e/part/' || l_partkey || '>' AS s, '<http://e/supplier/' || l_suppkey || '>' AS o FROM lineitem",
    "recorded_runs": (
        f"SELECT conv_id || '/' || turn AS pair_id, (role = 'user') = (r2 = 'user') AS ok_match, role = r2 AS error_match, CASE WHEN len(u) = 0 THEN (role = 'user' AND r2 = 'user')::INT::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / len(u) END AS stdout_overlap, (turn + 1)::DOUBLE / (t2 + 1) AS duration_ratio "
        f"FROM (SELECT *, list_distinct(list_concat(a, b)) AS u FROM (SELECT *, {_TOKENS.format('text')} AS a, {_TOKENS.format('x2')} AS b FROM (SELECT *, lead(turn) OVER w AS t2, lead(role) OVER w AS r2, lead(text) OVER w AS x2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE t2 IS NOT NULL))"
    ),
    "coverage": (
        "SELECT type, p AS \"precision\", r AS recall, f AS f1, round((0.4 * round(f, 3) + 0.3 * round(r, 3) + 0.3 * p) * 1000)::BIGINT AS weighted FROM (SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f FROM ("
        "SELECT type, CASE WHEN a = 0 AND b = 0 THEN 1.0 WHEN b = 0 THEN 0.0 ELSE m::DOUBLE / b END AS p, CASE WHEN a = 0 THEN 1.0 ELSE m::DOUBLE / a END AS r FROM (SELECT lang AS type, count(DISTINCT source) FILTER (doc_id % 2 = 0) AS a, count(DISTINCT source) FILTER (doc_id % 2 = 1) AS b, "
        "(SELECT count(*) FROM (SELECT source FROM documents x WHERE x.lang = d.lang GROUP BY source HAVING bool_or(doc_id % 2 = 0) AND bool_or(doc_id % 2 = 1))) AS m FROM documents d WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY lang)))"
    ),
    "listened_edges": "SELECT a.conv_id::VARCHAR AS flow, 's' || a.turn AS src, 's' || b.turn AS dst FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND (a.turn % 2 = 1 AND b.turn % 2 = 0 AND b.turn > 0 OR a.turn % 2 = 0 AND b.turn = a.turn + 1)",
    "turn_topology": (
        "WITH c AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'agent' WHEN 'user' THEN 'tool' ELSE 'other' END AS kind, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations), "
        "e AS (SELECT conv_id, turn AS src, CASE WHEN turn = last THEN -1 ELSE turn + 1 END AS dst FROM c WHERE turn % 3 = 1 UNION SELECT conv_id, turn, turn - 2 FROM c WHERE turn % 3 = 1 AND turn >= 2), "
        "f AS (SELECT e.conv_id, src, count(*) FILTER (kind = 'agent') AS a, count(*) FILTER (kind = 'tool') AS t, count(*) FILTER (dst = -1) AS x FROM e LEFT JOIN c ON c.conv_id = e.conv_id AND c.turn = e.dst GROUP BY 1, 2), "
        "r AS (SELECT conv_id, max(a) AS fan, bool_or(t > 0 AND x + a > 0) AS loops FROM f GROUP BY 1) "
        "SELECT g.conv_id::VARCHAR AS flow, CASE WHEN g.conv_id % 5 = 0 AND turns > 1 AND agents >= 2 THEN 'Hierarchical' WHEN fan IS NULL THEN 'Sequential' WHEN fan >= 2 THEN 'Hierarchical' WHEN loops THEN 'ReActLoop' ELSE 'Custom' END AS pattern "
        "FROM (SELECT conv_id, count(*) FILTER (kind = 'agent') AS agents, count(*) FILTER (turn = 1) + 1 AS turns FROM c GROUP BY 1) g LEFT JOIN r ON r.conv_id = g.conv_id"
    ),
    "matched_means": "SELECT l_linestatus AS block, count(*) AS matched, round(avg(round(l_discount, 3)::DOUBLE), 3) AS mean_score FROM lineitem GROUP BY 1",
}
