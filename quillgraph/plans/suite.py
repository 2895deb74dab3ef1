"""Graph queries over ordinary tables by the direct mapping, each with its plain SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import terms as T
from ..operators import align, compare, extract, graph, report, workflow
from ..operators.algebra import evaluate
from ..operators.graph import Mapping, Store, TableStore, TripleStore
from ..sources import trees
from .sparql import parse

MAPPINGS = {
    "region": Mapping(("r_regionkey",)),
    "nation": Mapping(("n_nationkey",), {"n_regionkey": "region"}),
    "customer": Mapping(("c_custkey",), {"c_nationkey": "nation"}),
    "supplier": Mapping(("s_suppkey",), {"s_nationkey": "nation"}),
    "part": Mapping(("p_partkey",)),
    "orders": Mapping(("o_orderkey",), {"o_custkey": "customer"}),
    "lineitem": Mapping(("l_orderkey", "l_linenumber"), {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
    "events": Mapping(("event_id",)),
    "documents": Mapping(("doc_id",)),
    "labels": Mapping(("doc_id",), {"doc_id": "documents"}),
    "conversations": Mapping(("conv_id", "turn"), {"next": "conversations"}),
    "benchmark": Mapping(("item_id",)),
}


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    out = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    if "conversations" in out:  # each turn knows the next one
        after = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
        out["conversations"] = out["conversations"].withColumn("next", F.concat(F.col("conv_id").cast("string"), F.lit("/"), after.cast("string")))
    return out


def store(spark: SparkSession, sf_dir: str, *names: str, materialised: bool = False) -> Store:
    s = TableStore(tables(spark, sf_dir, *names), {n: MAPPINGS[n] for n in names})
    return TripleStore(s.materialised()) if materialised else s


def ask(text: str, s: Store, **casts: str) -> DataFrame:
    """The query's rows with lexical forms, cast where asked."""
    prefixes = "".join(f"PREFIX {n}: <{n}#> " for n in MAPPINGS)
    return evaluate(parse(prefixes + text), s, lambda c: T.lexical(F.col(c)).cast(casts.get(c, "string")))


#: name: (tables, query, casts, SQL). Each runs on tables or, with the same result, on their triples.
PATTERNS: dict[str, tuple[tuple[str, ...], str, dict[str, str], str]] = {
    "bgp_scan": (("supplier",), "SELECT ?s ?n WHERE { ?s supplier:s_nationkey ?n } ORDER BY ?s", {}, "SELECT 'supplier/' || s_suppkey AS s, 'nation/' || s_nationkey AS n FROM supplier WHERE s_nationkey IS NOT NULL"),
    "bgp_star": (("customer",), "SELECT ?c ?name ?segment ?balance WHERE { ?c a <customer> ; customer:c_name ?name ; customer:c_mktsegment ?segment ; customer:c_acctbal ?balance }", {"balance": "double"}, "SELECT 'customer/' || c_custkey AS c, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance FROM customer WHERE c_name IS NOT NULL AND c_mktsegment IS NOT NULL AND c_acctbal IS NOT NULL"),
    "bgp_chain": (("customer", "nation", "region"), "SELECT ?c ?nation ?region WHERE { ?c customer:c_nationkey ?n . ?n nation:n_name ?nation ; nation:n_regionkey ?r . ?r region:r_name ?region }", {}, "SELECT 'customer/' || c_custkey AS c, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "optional_left": (("documents", "labels"), 'SELECT ?d (IF(BOUND(?q), "yes", "no") AS ?labelled) ?q WHERE { ?d a <documents> . OPTIONAL { ?l labels:doc_id ?d ; labels:quality ?q } } ORDER BY ?d', {"q": "int"}, "SELECT 'documents/' || d.doc_id AS d, CASE WHEN quality IS NULL THEN 'no' ELSE 'yes' END AS labelled, quality AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"),
    "optional_multi": (("customer", "orders"), "SELECT ?c ?o ?p WHERE { ?c customer:c_name ?name . OPTIONAL { ?o orders:o_custkey ?c } OPTIONAL { ?o orders:o_orderpriority ?p } }", {}, "SELECT 'customer/' || c_custkey AS c, 'orders/' || o_orderkey AS o, o_orderpriority AS p FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IS NOT NULL UNION ALL SELECT 'customer/' || c_custkey, 'orders/' || o_orderkey, o_orderpriority FROM customer, orders WHERE NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = c_custkey)"),
    "optional_group": (("orders", "lineitem", "part"), "SELECT ?o ?l ?brand WHERE { ?o a <orders> . OPTIONAL { ?l lineitem:l_orderkey ?o ; lineitem:l_partkey ?p . ?p part:p_brand ?brand } }", {}, "SELECT 'orders/' || o_orderkey AS o, 'lineitem/' || l_orderkey || '/' || l_linenumber AS l, p_brand AS brand FROM orders LEFT JOIN (lineitem JOIN part ON l_partkey = p_partkey) ON l_orderkey = o_orderkey"),
    "union_extend": (("customer", "supplier"), 'SELECT ?x ?kind ?n WHERE { { ?x customer:c_nationkey ?n . BIND("buyer" AS ?kind) } UNION { ?x supplier:s_nationkey ?n . BIND("seller" AS ?kind) } }', {}, "SELECT 'customer/' || c_custkey AS x, 'buyer' AS kind, 'nation/' || c_nationkey AS n FROM customer WHERE c_nationkey IS NOT NULL UNION ALL SELECT 'supplier/' || s_suppkey, 'seller', 'nation/' || s_nationkey FROM supplier WHERE s_nationkey IS NOT NULL"),
    "select_exprs": (("documents", "labels"), 'SELECT ?d (COALESCE(?t, ?q, "none") AS ?first) (IF(BOUND(?t) || BOUND(?q), "some", "none") AS ?any) WHERE { ?d documents:lang ?lang . OPTIONAL { ?l labels:doc_id ?d ; labels:toxic ?t OPTIONAL { ?l labels:quality ?q } } FILTER(BOUND(?l)) }', {}, "SELECT 'documents/' || d.doc_id AS d, coalesce(CAST(toxic AS VARCHAR), CAST(quality AS VARCHAR), 'none') AS \"first\", CASE WHEN toxic IS NOT NULL OR quality IS NOT NULL THEN 'some' ELSE 'none' END AS \"any\" FROM documents d JOIN labels l ON l.doc_id = d.doc_id AND toxic IS NOT NULL WHERE lang IS NOT NULL"),
    "filter_ne": (("events",), 'SELECT ?e ?kind WHERE { ?e events:event_type ?kind . FILTER(?kind != "error") FILTER(?kind != "view") }', {}, "SELECT 'events/' || event_id AS e, event_type AS kind FROM events WHERE event_type <> 'error' AND event_type <> 'view'"),
    "optional_unbound": (
        ("region", "nation"),
        'SELECT ?r ?n ?name WHERE { ?r a <region> . OPTIONAL { ?r region:r_name "ASIA" . ?n nation:n_regionkey ?r } OPTIONAL { ?n nation:n_name ?name } }',
        {},
        "WITH a AS (SELECT r_regionkey, n_nationkey FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND r_name = 'ASIA') SELECT 'region/' || r_regionkey AS r, 'nation/' || coalesce(a.n_nationkey, n.n_nationkey) AS n, n_name AS name FROM a LEFT JOIN nation n ON a.n_nationkey = n.n_nationkey OR a.n_nationkey IS NULL",
    ),
    "not_exists": (("documents", "labels"), "SELECT ?d ?lang WHERE { ?d documents:lang ?lang . FILTER NOT EXISTS { ?l labels:doc_id ?d } }", {}, "SELECT 'documents/' || doc_id AS d, lang FROM documents d WHERE lang IS NOT NULL AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"),
    "not_exists_unbound": (
        ("region", "nation", "supplier"),
        'SELECT ?r ?n WHERE { ?r a <region> . OPTIONAL { ?r region:r_name "ASIA" . ?n nation:n_regionkey ?r } FILTER NOT EXISTS { ?n nation:n_name "INDIA" } }',
        {},
        "SELECT 'region/' || r_regionkey AS r, 'nation/' || n_nationkey AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND r_name = 'ASIA' WHERE NOT EXISTS (SELECT 1 FROM nation x WHERE x.n_name = 'INDIA' AND (x.n_nationkey = nation.n_nationkey OR nation.n_nationkey IS NULL))",
    ),
    "exists_marker": (("nation", "supplier", "customer"), 'SELECT ?n (IF(EXISTS { ?s supplier:s_nationkey ?n }, "sells", IF(EXISTS { ?c customer:c_nationkey ?n }, "buys", "other")) AS ?kind) WHERE { ?n a <nation> }', {}, "SELECT 'nation/' || n_nationkey AS n, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) THEN 'sells' WHEN EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey) THEN 'buys' ELSE 'other' END AS kind FROM nation"),
    "regex_classify": (("events",), 'SELECT ?e ?class WHERE { ?e a <events> . OPTIONAL { ?e events:event_type ?t } BIND(IF(REGEX(COALESCE(?t, ""), "PURCH|sign", "i"), "gain", IF(REGEX(COALESCE(?t, ""), "err", "i"), "loss", IF(BOUND(?t), "other", "none"))) AS ?class) }', {}, "SELECT 'events/' || event_id AS e, CASE WHEN regexp_matches(coalesce(event_type, ''), 'PURCH|sign', 'i') THEN 'gain' WHEN regexp_matches(coalesce(event_type, ''), 'err', 'i') THEN 'loss' WHEN event_type IS NOT NULL THEN 'other' ELSE 'none' END AS class FROM events"),
    "path_seq": (("lineitem", "orders", "customer"), "SELECT ?l ?n WHERE { ?l lineitem:l_orderkey/orders:o_custkey/customer:c_nationkey ?n }", {}, "SELECT 'lineitem/' || l_orderkey || '/' || l_linenumber AS l, 'nation/' || c_nationkey AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"),
    "path_alt": (("customer", "supplier", "nation"), "SELECT ?x ?name WHERE { ?x customer:c_nationkey|supplier:s_nationkey ?n . ?n nation:n_name ?name }", {}, "SELECT 'customer/' || c_custkey AS x, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'supplier/' || s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "path_plus": (("conversations",), "SELECT ?a ?b WHERE { ?a conversations:next+ ?b }", {}, "SELECT DISTINCT 'conversations/' || a.conv_id || '/' || a.turn AS a, 'conversations/' || b.conv_id || '/' || b.turn AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn"),
    "path_plus_typed": (("conversations",), 'SELECT ?a ?b WHERE { ?a conversations:next+ ?b . ?b conversations:role "assistant" }', {}, "SELECT DISTINCT 'conversations/' || a.conv_id || '/' || a.turn AS a, 'conversations/' || b.conv_id || '/' || b.turn AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn AND b.role = 'assistant'"),
    "config_lookup": (("orders", "customer"), 'SELECT ?o ?balance WHERE { ?o orders:o_custkey ?c . ?c customer:c_mktsegment "BUILDING" ; customer:c_acctbal ?balance }', {"balance": "double"}, "SELECT 'orders/' || o_orderkey AS o, c_acctbal AS balance FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND c_acctbal IS NOT NULL"),
}

_RATES = "matched / nullif(n_cand, 0)::DOUBLE"


def _prf(source: str, by: str = "") -> str:
    """SQL of precision, recall and F1 over (n_ref, n_cand) rows."""
    pre = f"{by}, " if by else ""
    return (
        f"SELECT {pre}CAST(m AS BIGINT) AS matched, CAST(r AS BIGINT) AS n_ref, CAST(c AS BIGINT) AS n_cand, p AS precision, q AS recall, CASE WHEN p + q = 0 THEN 0.0 ELSE 2 * p * q / (p + q) END AS f1 FROM ("
        f"SELECT *, CASE WHEN c = 0 THEN 0.0 ELSE m::DOUBLE / c END AS p, CASE WHEN r = 0 THEN 0.0 ELSE m::DOUBLE / r END AS q FROM (SELECT {pre}sum(least(n_ref, n_cand)) AS m, sum(n_ref) AS r, sum(n_cand) AS c FROM ({source})" + (f" GROUP BY {by}" if by else "") + "))"
    )


def _full(ref: str, cand: str, keys: tuple[str, ...]) -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    names = ", ".join(f"coalesce(a.{k}, b.{k}) AS {k}" for k in keys)
    return f"SELECT {names}, coalesce(a.n, 0) AS n_ref, coalesce(b.n, 0) AS n_cand FROM ({ref}) a FULL JOIN ({cand}) b ON {on}"


def _one_pair(spark: SparkSession, ref: str, cand: str) -> DataFrame:
    return spark.range(1).select(F.lit("x").alias("pair_id"), F.lit(ref).alias("ref_id"), F.lit(cand).alias("cand_id"))


GRAPH_TABLES = ("region", "nation", "supplier", "customer")
VOCABULARY = tuple(f"{t}#" for t in GRAPH_TABLES)


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = TableStore(tables(spark, sf_dir, *GRAPH_TABLES), {n: MAPPINGS[n] for n in GRAPH_TABLES})
    return s.materialised().withColumn("graph_id", F.lit("g")).select("graph_id", "s", "p", "o")


def objects_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.objects(_graph(spark, sf_dir), "<nation#n_name>").select("s", T.lexical(F.col("o")).alias("name"))


def holds_triple(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    rows = graph.subjects(g, T.TYPE, "<nation>")
    return graph.holds(rows, g, "<nation#n_regionkey>", "<region/2>").select("s", "holds")


def direction_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("lang").alias("framework"), F.col("source").alias("target"), "n_chars")
    return compare.direction_means(d, ["n_chars"])


def count_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type is not null")
    counts = e.groupBy(F.when(F.col("event_id") % 3 == 0, "left").otherwise("right").alias("side"), F.col("event_type").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    kinds = e.select(F.col("event_type").alias("left_key")).distinct()
    rules = kinds.select(F.col("left_key").alias("rule"), "left_key", F.col("left_key").alias("right_key")).union(spark.sql("SELECT 'none', 'nothing', 'nothing' UNION ALL SELECT 'half', 'view', 'nothing'"))
    return compare.count_agreement(rules, counts)


def text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_name", "s_suppkey", "s_acctbal")
    return report.text_report(s, "s_name")


def latest_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("report/"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderkey").alias("modified"))
    return report.latest(o, 10)


def source_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", extract.python_text(F.col("text")).alias("escaped"), trees.default_namespace(F.col("source")).alias("namespace"), trees.default_system_name(F.col("lang")).alias("name"))


def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.class_histogram(_graph(spark, sf_dir)).drop("graph_id")


def intrinsic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.intrinsic(_graph(spark, sf_dir), VOCABULARY).drop("graph_id")


def property_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.property_usage(_graph(spark, sf_dir), VOCABULARY).drop("graph_id")


def individual_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = d.where("source is not null").groupBy((F.col("doc_id") % 2).cast("string").alias("graph_id"), F.col("source").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return compare.multiset_scores(counts, _one_pair(spark, "0", "1"), ["class"]).drop("pair_id")


def property_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    counts = e.where("event_type is not null").groupBy(F.when(F.col("event_id") % 1000 < 500, "a").otherwise("b").alias("graph_id"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return compare.multiset_scores(counts, _one_pair(spark, "a", "b"), ["event_type"], by=["event_type"]).drop("pair_id")


def triple_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("graph_id"), "l_partkey", "l_suppkey")
    return compare.set_scores(rows, _one_pair(spark, "R", "A"), ["l_partkey", "l_suppkey"]).drop("pair_id")


def literal_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("source in ('src0', 'src1')")
    texts = d.select(F.col("source").alias("graph_id"), T.folded(F.col("text")).alias("text")).where("text <> ''").distinct()
    return compare.literal_overlap(texts, _one_pair(spark, "src0", "src1")).drop("pair_id")


def missing_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    counts = p.where("p_size <= 50").groupBy(F.when(F.col("p_partkey") % 7 == 0, "a").otherwise("b").alias("graph_id"), F.concat_ws("|", "p_brand", "p_type").alias("property")).agg(F.count(F.lit(1)).alias("n"))
    return compare.missing_and_extra(counts, _one_pair(spark, "a", "b"), "property").drop("pair_id")


def feature_macro_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = p.select(F.when(F.col("p_partkey") % 2 == 0, "a").otherwise("b").alias("graph_id"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in ("p_brand", "p_type", "p_name", "p_size")])).alias("x"))
    out = compare.macro_scores(rows.select("graph_id", "x.feature", "x.value").where("value is not null"), _one_pair(spark, "a", "b"), rounded=None).drop("pair_id")
    return out.select(*[F.round(F.col(c) * 1e6).cast("long").alias(c) for c in out.columns])


def group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.group_means(spark.read.parquet(f"{sf_dir}/documents.parquet"), "lang", ["n_chars"])


def token_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    words = b.select(F.col("item_id").cast("string").alias("s"), F.explode(F.array_distinct(F.filter(F.split(T.folded(F.col("text")), " "), lambda w: w != ""))).alias("feature")).withColumn("graph_id", F.lit("g"))
    rows = align.jaccard_pairs(words, _one_pair(spark, "g", "g")).where("cast(ref as bigint) < cast(cand as bigint) and score >= 0.05")
    return rows.select(F.col("ref").cast("long").alias("a"), F.col("cand").cast("long").alias("b"), "score")


def greedy_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir, "supplier", "customer")
    feature = lambda df, who, key, nation, balance: df.select(F.lit(who).alias("graph_id"), F.concat(F.lit(f"{who}/"), F.col(key)).alias("s"), F.explode(F.array(F.concat(F.lit("n"), F.col(nation)), F.concat(F.lit("b"), F.floor(F.col(balance) / 500)), F.concat(F.lit("k"), F.col(key) % 97))).alias("feature"))
    rows = feature(t["supplier"], "supplier", "s_suppkey", "s_nationkey", "s_acctbal").unionByName(feature(t["customer"].where("c_custkey is not null"), "customer", "c_custkey", "c_nationkey", "c_acctbal"))
    kinds = rows.where("feature like 'n%'").select("graph_id", "s", F.col("feature").alias("class"))
    return align.jaccard_aligned(rows, _one_pair(spark, "supplier", "customer"), kinds)


def fuzzy_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against perturbed ones among parts of one brand, type and size."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    both = p.select(F.lit("a").alias("graph_id"), F.concat_ws("|", "p_brand", "p_type", "p_size").alias("class"), F.col("p_partkey").cast("string").alias("s"), F.col("p_name").alias("label"))
    changed = both.withColumn("graph_id", F.lit("b")).withColumn("label", F.concat(F.initcap(F.lower("label")), F.lit(" land")))
    return align.fuzzy_aligned(both.unionByName(changed), _one_pair(spark, "a", "b"))


def workflow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.chain(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn")


def end_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn")
    edges = workflow.chain(c, "conv_id", "turn").select("conv_id", F.col("turn").alias("src"), F.col("next").alias("dst")).where("dst is not null")
    return workflow.ends(c.withColumnRenamed("turn", "step"), edges, "conv_id").withColumnRenamed("step", "turn")


def implicit_dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", (F.col("role") == "system").alias("free"))
    return workflow.sequential_dependencies(c, "conv_id", "turn", "free")


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.from_json("props", "k long").getField("k").alias("k")).where("k is not null")


def substring_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, d = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("benchmark", "documents"))
    return compare.content_recall(b.select(F.col("item_id").alias("id"), "text"), d.select("text")).withColumnRenamed("id", "item_id")


def _pattern(name: str):
    names, text, casts, _ = PATTERNS[name]

    def run(spark: SparkSession, sf_dir: str, materialised: bool = False) -> DataFrame:
        return ask(text, store(spark, sf_dir, *names, materialised=materialised), **casts)

    return run


QUERIES = {n: _pattern(n) for n in PATTERNS} | {
    f.__name__: f
    for f in (objects_of, holds_triple, direction_means, count_agreement, text_report, latest_reports, source_texts, class_histogram, intrinsic_counts, property_usage, individual_prf, property_prf, triple_prf, literal_overlap, missing_extra, feature_macro_prf, group_means, token_jaccard_pairs, greedy_align, fuzzy_align, workflow_edges, end_steps, implicit_dependency, json_props, substring_recall)
}

_COLUMNS = {"region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"), "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")}
_TYPES = " UNION ALL ".join(f"SELECT '{t}' AS class, count(*) AS n FROM {t}" for t in GRAPH_TABLES)
_USES = " UNION ALL ".join(f"SELECT '{c}' AS property, count({c}) AS n FROM {t}" for t, cs in _COLUMNS.items() for c in cs)
_LINKS = "(SELECT count(n_regionkey) FROM nation) + (SELECT count(s_nationkey) FROM supplier) + (SELECT count(c_nationkey) FROM customer)"
_WORDS = "(SELECT DISTINCT item_id, unnest(string_split(trim(lower(regexp_replace(text, '\\s+', ' ', 'g'))), ' ')) AS w FROM benchmark)"
_FOLD = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"
_PART = " UNION ALL ".join(f"SELECT DISTINCT p_partkey % 2 AS g, '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM part WHERE {c} IS NOT NULL" for c in ("p_brand", "p_type", "p_name", "p_size"))

ORACLES = {n: q[3] for n, q in PATTERNS.items()} | {
    "class_histogram": _TYPES,
    "intrinsic_counts": f"SELECT CAST(t AS BIGINT) AS triples, CAST(t AS BIGINT) AS abox_triples, CAST(k AS BIGINT) AS properties, CAST(t - i - l AS BIGINT) AS literals, CAST(l AS BIGINT) AS links, CAST(i AS BIGINT) AS individuals, t::DOUBLE / i AS density FROM (SELECT (SELECT sum(n) FROM ({_TYPES})) + (SELECT sum(n) FROM ({_USES})) AS t, (SELECT count(*) FROM ({_USES}) WHERE n > 0) AS k, {_LINKS} AS l, (SELECT sum(n) FROM ({_TYPES})) AS i)",
    "property_usage": f"SELECT property, n FROM ({_USES}) WHERE n > 0",
    "individual_prf": _prf(_full("SELECT source, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY 1", "SELECT source, count(*) AS n FROM documents WHERE doc_id % 2 = 1 GROUP BY 1", ("source",))),
    "property_prf": _prf(_full("SELECT event_type, count(*) AS n FROM events WHERE event_id % 1000 < 500 GROUP BY 1", "SELECT event_type, count(*) AS n FROM events WHERE event_id % 1000 >= 500 GROUP BY 1", ("event_type",)), "event_type"),
    "triple_prf": _prf(_full("SELECT DISTINCT l_partkey, l_suppkey, 1 AS n FROM lineitem WHERE l_returnflag = 'R'", "SELECT DISTINCT l_partkey, l_suppkey, 1 AS n FROM lineitem WHERE l_returnflag = 'A'", ("l_partkey", "l_suppkey"))),
    "literal_overlap": f"SELECT CASE WHEN r = 0 THEN 0.0 ELSE m::DOUBLE / r END AS literal_overlap, CASE WHEN r + c - m = 0 THEN 0.0 ELSE m::DOUBLE / (r + c - m) END AS literal_jaccard FROM (SELECT count(*) FILTER (a) AS r, count(*) FILTER (b) AS c, count(*) FILTER (a AND b) AS m FROM (SELECT {_FOLD} AS t, bool_or(source = 'src0') AS a, bool_or(source = 'src1') AS b FROM documents WHERE source IN ('src0', 'src1') GROUP BY 1 HAVING t <> ''))",
    "missing_extra": "SELECT property, CASE WHEN b = 0 THEN 'missing' ELSE 'extra' END AS side FROM (SELECT p_brand || '|' || p_type AS property, count(*) FILTER (p_partkey % 7 = 0) AS a, count(*) FILTER (p_partkey % 7 <> 0) AS b FROM part WHERE p_size <= 50 GROUP BY 1) WHERE a = 0 OR b = 0",
    "feature_macro_prf": f"SELECT CAST(round(avg(p) * 1e6) AS BIGINT) AS overall_precision, CAST(round(avg(q) * 1e6) AS BIGINT) AS overall_recall, CAST(round(avg(CASE WHEN p + q = 0 THEN 0.0 ELSE 2 * p * q / (p + q) END) * 1e6) AS BIGINT) AS overall_f1 FROM (SELECT feature, CASE WHEN sum(b) = 0 THEN 0.0 ELSE sum(a * b)::DOUBLE / sum(b) END AS p, CASE WHEN sum(a) = 0 THEN 0.0 ELSE sum(a * b)::DOUBLE / sum(a) END AS q FROM (SELECT feature, value, max(CASE WHEN g = 0 THEN 1 ELSE 0 END) AS a, max(CASE WHEN g = 1 THEN 1 ELSE 0 END) AS b FROM ({_PART}) GROUP BY 1, 2) GROUP BY 1)",
    "group_means": "SELECT lang, avg(n_chars) AS n_chars, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), ())",
    "token_jaccard_pairs": f"SELECT a, b, m::DOUBLE / (x + y - m) AS score FROM (SELECT p.item_id AS a, q.item_id AS b, count(*) AS m FROM {_WORDS} p JOIN {_WORDS} q ON p.w = q.w AND p.item_id < q.item_id AND p.w <> '' GROUP BY 1, 2) JOIN (SELECT item_id, count(*) AS x FROM {_WORDS} WHERE w <> '' GROUP BY 1) s ON s.item_id = a JOIN (SELECT item_id, count(*) AS y FROM {_WORDS} WHERE w <> '' GROUP BY 1) t ON t.item_id = b WHERE m::DOUBLE / (x + y - m) >= 0.05",
    "objects_of": "SELECT '<nation/' || n_nationkey || '>' AS s, n_name AS name FROM nation",
    "holds_triple": "SELECT '<nation/' || n_nationkey || '>' AS s, n_regionkey = 2 AS holds FROM nation",
    "direction_means": "SELECT lang AS framework, source AS target, avg(n_chars) AS n_chars, count(*) AS n FROM documents GROUP BY ALL",
    "count_agreement": (
        "WITH c AS (SELECT event_type AS k, count(*) FILTER (event_id % 3 = 0) AS l, count(*) FILTER (event_id % 3 <> 0) AS r FROM events WHERE event_type IS NOT NULL GROUP BY 1), "
        "s AS (SELECT k AS rule, l AS \"left\", r AS \"right\" FROM c UNION ALL SELECT 'none', 0, 0 UNION ALL SELECT 'half', coalesce((SELECT l FROM c WHERE k = 'view'), 0), 0) "
        "SELECT *, CASE WHEN \"left\" = 0 AND \"right\" = 0 THEN NULL ELSE least(\"left\", \"right\")::DOUBLE / greatest(\"left\", \"right\") END AS score FROM s"
    ),
    "text_report": "SELECT s_name, '== ' || s_name || ' ==' || chr(10) || '  s_suppkey: ' || s_suppkey || chr(10) || '  s_acctbal: ' || coalesce(printf('%.3f', s_acctbal), '—') AS text FROM supplier",
    "latest_reports": "SELECT 'report/' || o_orderkey AS path, o_orderkey AS modified FROM orders ORDER BY o_orderkey DESC LIMIT 10",
    "source_texts": "SELECT doc_id, replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') AS escaped, 'http://example.org/' || replace(source, '-', '_') || '#' AS namespace, replace(lang, '-', '_') AS name FROM documents",
    "workflow_edges": "SELECT conv_id, turn, lead(turn) OVER w AS next, lag(turn) OVER w AS previous FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "end_steps": "SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY 1",
    "implicit_dependency": "SELECT a.conv_id, b.turn AS step, a.turn AS predecessor FROM (SELECT *, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations) a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.nx WHERE b.role <> 'system'",
    "json_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL",
    "substring_recall": f"SELECT item_id, EXISTS (SELECT 1 FROM (SELECT {_FOLD} AS t FROM documents) d WHERE contains(d.t, b.w)) AS found FROM (SELECT item_id, {_FOLD} AS w FROM benchmark) b",
}
