"""Scores of graphs and feature sets: counts, precision, recall and F1 as aggregations.

Pairwise functions take triples with a graph_id and `pairs` (pair_id, ref_id, cand_id), so any number
of comparisons is one plan. Scores whose denominator is 0 are 0.0.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from .closure import checkpointed


def assertions(triples: DataFrame, vocabulary: tuple[str, ...]) -> DataFrame:
    """Triples about individuals: not schema, subject outside the vocabulary, no blank ends."""
    s, p, o = F.col("s"), F.col("p"), F.col("o")
    return triples.where(~T.is_schema(p, o) & ~T.in_namespaces(s, vocabulary) & ~T.is_blank(s) & ~T.is_blank(o))


def individuals(triples: DataFrame, vocabulary: tuple[str, ...]) -> DataFrame:
    """graph_id, class, name: distinct local names of each class's IRI subjects."""
    s, o = F.col("s"), F.col("o")
    rows = triples.where((F.col("p") == T.TYPE) & ~o.isin(*T.SCHEMA_TYPES) & T.is_iri(s) & ~T.in_namespaces(s, vocabulary))
    return rows.select("graph_id", T.local_name(o).alias("class"), T.local_name(s).alias("name")).distinct()


def intrinsic(triples: DataFrame, vocabulary: tuple[str, ...]) -> DataFrame:
    """graph_id, triples, abox_triples, individuals, properties, density, literals, links."""
    s, p, o = F.col("s"), F.col("p"), F.col("o")
    schema, vocab = T.is_schema(p, o), T.in_namespaces(s, vocabulary)
    about = ~schema & ~vocab
    counts = triples.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("triples"),
        F.count_if(about & ~T.is_blank(s) & ~T.is_blank(o)).alias("abox_triples"),
        F.countDistinct(F.when(~schema & T.in_namespaces(p, vocabulary), p)).alias("properties"),
        F.count_if(about & T.is_literal(o)).alias("literals"),
        F.count_if(about & T.is_iri(o) & (p != T.TYPE)).alias("links"),
    )
    found = individuals(triples, vocabulary).groupBy("graph_id").agg(F.count(F.lit(1)).alias("individuals"))
    out = counts.join(found, "graph_id", "left").withColumn("individuals", F.coalesce("individuals", F.lit(0)))
    return out.withColumn("density", T.ratio(F.col("abox_triples"), F.col("individuals")))


def class_histogram(triples: DataFrame) -> DataFrame:
    return triples.where(F.col("p") == T.TYPE).groupBy("graph_id", T.local_name(F.col("o")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def property_usage(triples: DataFrame, vocabulary: tuple[str, ...]) -> DataFrame:
    rows = assertions(triples, vocabulary).where(T.in_namespaces(F.col("p"), vocabulary))
    uses = rows.groupBy("graph_id", "p").agg(F.count(F.lit(1)).alias("n"))  # a name is cut out once a property, not once a triple
    return uses.groupBy("graph_id", T.local_name(F.col("p")).alias("property")).agg(F.sum("n").alias("n"))


def unused(names: DataFrame, triples: DataFrame) -> DataFrame:
    """Names (one column, name) that no predicate's local name has."""
    return names.join(triples.select(T.local_name(F.col("p")).alias("name")).distinct(), "name", "left_anti")


def scored(matched: Column, n_cand: Column, n_ref: Column) -> list[Column]:
    p, r = T.ratio(matched, n_cand), T.ratio(matched, n_ref)
    return [p.alias("precision"), r.alias("recall"), T.f1(p, r).alias("f1")]


def sides(counts: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of both graphs' counts (graph_id, keys, n) for every pair: n_ref, n_cand."""
    side = lambda who: pairs.select("pair_id", F.col(who).alias("graph_id")).join(counts, "graph_id").drop("graph_id")
    both = side("ref_id").withColumnRenamed("n", "n_ref").join(side("cand_id").withColumnRenamed("n", "n_cand"), ["pair_id", *keys], "full")
    return both.withColumn("n_ref", F.coalesce("n_ref", F.lit(0))).withColumn("n_cand", F.coalesce("n_cand", F.lit(0)))


def multiset_scores(counts: DataFrame, pairs: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Sum of the smaller counts over the sums of both: per pair, and per `by` if given."""
    both = sides(counts, pairs, keys)
    sums = both.groupBy("pair_id", *(by or [])).agg(F.sum(F.least("n_ref", "n_cand")).alias("matched"), F.sum("n_cand").alias("n_cand"), F.sum("n_ref").alias("n_ref"))
    return sums.select("pair_id", *(by or []), "matched", "n_ref", "n_cand", *scored(F.col("matched"), F.col("n_cand"), F.col("n_ref")))


def missing_and_extra(counts: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """pair_id, key, side: what only the reference has (missing) or only the candidate (extra)."""
    both = sides(counts, pairs, [key]).where("n_ref = 0 or n_cand = 0")
    return both.select("pair_id", key, F.when(F.col("n_cand") == 0, "missing").otherwise("extra").alias("side"))


def set_scores(rows: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Scores of distinct rows (graph_id, keys) shared by both graphs."""
    return multiset_scores(rows.select("graph_id", *keys).distinct().withColumn("n", F.lit(1)), pairs, keys)


def shown_triples(triples: DataFrame, vocabulary: tuple[str, ...]) -> DataFrame:
    rows = assertions(triples, vocabulary)
    return rows.select("graph_id", T.local_name(F.col("s")).alias("s"), T.local_name(F.col("p")).alias("p"), T.shown(F.col("o")).alias("o")).distinct()


def literals(triples: DataFrame, vocabulary: tuple[str, ...]) -> DataFrame:
    rows = assertions(triples, vocabulary).where(T.is_literal(F.col("o")))
    return rows.select("graph_id", T.folded(T.lexical(F.col("o"))).alias("text")).where("text <> ''").distinct()


def literal_overlap(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, literal_overlap (share of the reference's texts that the candidate has), literal_jaccard."""
    s = set_scores(texts, pairs, ["text"])
    return s.select("pair_id", F.col("recall").alias("literal_overlap"), T.ratio(F.col("matched"), F.col("n_ref") + F.col("n_cand") - F.col("matched")).alias("literal_jaccard"))


def pairwise(triples: DataFrame, pairs: DataFrame, vocabulary: tuple[str, ...]) -> DataFrame:
    """All pairwise scores of a pair in a row."""
    classes = individuals(triples, vocabulary).groupBy("graph_id", "class").agg(F.count(F.lit(1)).alias("n"))
    out = pairs.select("pair_id")
    for name, s in (("individual", multiset_scores(classes, pairs, ["class"])), ("property", multiset_scores(property_usage(triples, vocabulary), pairs, ["property"])), ("triple", set_scores(shown_triples(triples, vocabulary), pairs, ["s", "p", "o"]))):
        out = out.join(s.select("pair_id", *[F.col(c).alias(f"{name}_{c}") for c in ("precision", "recall", "f1")]), "pair_id", "left")
    out = out.join(literal_overlap(literals(triples, vocabulary), pairs), "pair_id", "left")
    return out.fillna(0.0)


def macro_scores(features: DataFrame, pairs: DataFrame, rounded: int | None = 3) -> DataFrame:
    """pair_id, overall precision, recall and F1: means over the features that a side has.

    features: graph_id, feature, value. Scores of a feature are rounded first, as reports do, unless
    rounded is None."""
    rows = features.distinct().withColumn("n", F.lit(1))
    by = multiset_scores(rows, pairs, ["feature", "value"], by=["feature"])
    cut = (lambda c: F.round(c, rounded)) if rounded is not None else (lambda c: c)
    return by.groupBy("pair_id").agg(*[F.avg(cut(F.col(c))).alias(f"overall_{c}") for c in ("precision", "recall", "f1")])


def count_agreement(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """rule, score: the smaller over the greater count of a rule's two patterns; null if both are 0.

    rules: rule, left_key, right_key; counts: side (left or right), key, n."""
    side = lambda s: counts.where(F.col("side") == s).select(F.col("key").alias(f"{s}_key"), F.col("n").alias(s))
    both = rules.join(side("left"), "left_key", "left").join(side("right"), "right_key", "left").fillna(0, ["left", "right"])
    return both.select("rule", "left", "right", F.when((F.col("left") == 0) & (F.col("right") == 0), None).otherwise(T.ratio(F.least("left", "right"), F.greatest("left", "right"))).alias("score"))


def element_coverage(elements: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, type, precision, recall, f1 of (graph_id, type, key) sets, keys in lower case.

    With an empty reference recall is 1; with an empty candidate precision is 1 if both are empty."""
    rows = elements.select("graph_id", "type", F.lower("key").alias("key")).distinct().withColumn("n", F.lit(1))
    s = multiset_scores(rows, pairs, ["type", "key"], by=["type"]).select("pair_id", "type", "matched", "n_ref", "n_cand")
    types = pairs.select("pair_id").withColumn("_", F.lit(1)).join(rows.select("type").distinct().withColumn("_", F.lit(1)), "_").drop("_")
    s = types.join(s, ["pair_id", "type"], "left").fillna(0)
    p = F.when((F.col("n_cand") == 0) & (F.col("n_ref") == 0), 1.0).otherwise(T.ratio(F.col("matched"), F.col("n_cand")))
    r = F.when(F.col("n_ref") == 0, 1.0).otherwise(T.ratio(F.col("matched"), F.col("n_ref")))
    return s.select("pair_id", "type", p.alias("precision"), r.alias("recall"), T.f1(p, r).alias("f1"))


#: Bytes of wanted texts that one automaton holds: about 40 bytes of a worker's memory each.
AUTOMATON_BYTES = 4 << 20


def content_recall(wanted: DataFrame, texts: DataFrame, shortest: int = 1, block_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """id, found: whether a wanted text equals one of `texts` or is inside one, folded.

    Equality is a hash join. What is left is looked for by an automaton of many patterns, which reads each
    text once whatever the number of patterns. Wanted texts are broadcast in blocks of block_bytes, a job a
    block; a task reports each pattern at most once a batch. Null texts on either side match nothing, nor do
    wanted texts under `shortest` characters; ids that repeat are found if one of their texts is."""
    w = wanted.select("id", T.folded(F.col("text")).alias("w")).where(F.length("w") >= shortest)
    t = texts.select(T.folded(F.col("text")).alias("t")).where("t is not null")
    exact = w.join(t, w.w == t.t, "left_semi").select("id")
    rest = checkpointed(w.join(exact.distinct(), "id", "left_anti"))
    patterns = rest.select("w").distinct()
    size = patterns.agg(F.sum(F.octet_length("w"))).first()[0] or 0
    n = -(-size // block_bytes)
    hits = exact
    for k in range(n):
        block = [r.w for r in patterns.where(F.pmod(F.xxhash64("w"), F.lit(n)) == k).toLocalIterator()]
        inside = checkpointed(t.mapInArrow(_inside(t.sparkSession.sparkContext.broadcast(block)), "w string").distinct())
        hits = hits.union(rest.join(inside, "w", "left_semi").select("id"))
    return wanted.select("id").distinct().join(hits.distinct().withColumn("found", F.lit(True)), "id", "left").fillna(False, ["found"])


def _inside(block):
    """Of batches of texts, which texts of the block they hold. One text of a batch at a time is a Python string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = None
        for b in batches:
            if automaton is None and len(block.value):
                automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
                for k, text in enumerate(block.value):
                    automaton.add_word(text, k)
                automaton.make_automaton()
            found = {k for text in b.column("t") for _, k in automaton.iter(text.as_py())} if automaton is not None else set()
            yield pa.RecordBatch.from_pydict({"w": pa.array([block.value[k] for k in sorted(found)], pa.string())})

    return run


#: Which links are recalled: kind, property, prefix of the subject's and of the object's name (fixed values).
RELATIONS = (("agent_tool", "agentToolUsage", "Agent_", "Tool_"), ("task_agent", "performedByAgent", "Task_", "Agent_"), ("team_member", "hasAgentMember", "Team_", "Agent_"))


def relation_recall(links: DataFrame, triples: DataFrame, graphs: DataFrame, vocabulary) -> DataFrame:
    """graph_id, kind, source_count, graph_count, recall (to three places; 1 without links) of links found in sources.

    links: graph_id, kind, a, b of records (keys); triples: the graphs made of them; graphs: graph_id; vocabulary gives
    the address of a property. Keys are compared in lower case, without the prefixes of names in the graph."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(vocabulary(p)).alias("p"), F.lit(a).alias("pre_a"), F.lit(b).alias("pre_b")) for k, p, a, b in RELATIONS]))
    of = graphs.select("graph_id", kinds.alias("x")).select("graph_id", "x.kind", "x.p", "x.pre_a", "x.pre_b")
    key = lambda c, prefix: F.lower(F.replace(T.reader_name(F.col(c)), F.col(prefix), F.lit("")))
    there = triples.join(F.broadcast(of.select("p", "kind", "pre_a", "pre_b").distinct()), "p").select("graph_id", "kind", key("s", "pre_a").alias("a"), key("o", "pre_b").alias("b")).distinct()
    here = links.select("graph_id", "kind", F.lower("a").alias("a"), F.lower("b").alias("b")).distinct()
    count = lambda df, name: df.groupBy("graph_id", "kind").agg(F.count(F.lit(1)).alias(name))
    out = of.select("graph_id", "kind")
    for df, name in ((here, "source_count"), (there, "graph_count"), (here.join(there, ["graph_id", "kind", "a", "b"], "left_semi"), "_both")):
        out = out.join(count(df, name), ["graph_id", "kind"], "left")
    out = out.fillna(0, ["source_count", "graph_count", "_both"])
    return out.select("graph_id", "kind", "source_count", "graph_count", F.when(F.col("source_count") == 0, 1.0).otherwise(F.round(F.col("_both") / F.col("source_count"), 3)).alias("recall"))


def conformance(scores: DataFrame) -> DataFrame:
    """score, n_rules: the mean of the rules that apply."""
    return scores.agg(F.avg("score").alias("score"), F.count("score").alias("n_rules"))


def weighted_coverage(element_f1: Column, relation_recall: Column, content: Column) -> Column:
    """Fixed weights of the coverage score."""
    return 0.4 * F.round(element_f1, 3) + 0.3 * F.round(relation_recall, 3) + 0.3 * content


def direction_means(rows: DataFrame, numbers: list[str], keys: tuple[str, ...] = ("framework", "target")) -> DataFrame:
    """A row of means, nulls left out, for each direction (source and target), in order."""
    return rows.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in numbers], F.count(F.lit(1)).alias("n")).orderBy(*keys)


def group_means(rows: DataFrame, group: str, numbers: list[str]) -> DataFrame:
    """A row of means for each group and one over all rows (group null), nulls left out."""
    rows = rows.withColumn("_group", F.col(group))
    out = rows.groupingSets([[F.col("_group")], []], F.col("_group")).agg(*[F.avg(c).alias(c) for c in numbers], F.count(F.lit(1)).alias("n"))
    return out.withColumnRenamed("_group", group)


def execution_agreement(runs: DataFrame) -> DataFrame:
    """ok_match, error_match, stdout_overlap, duration_ratio of recorded runs (columns ref_*, cand_*)."""
    clean = lambda c: F.array_distinct(F.transform(F.filter(F.split(c, r"\s+"), lambda w: w != ""), lambda w: F.regexp_replace(w, r"^\p{Punct}+|\p{Punct}+$", "")))
    a, b = clean(F.coalesce("ref_stdout", F.lit(""))), clean(F.coalesce("cand_stdout", F.lit("")))
    kind = lambda c: F.substring_index(F.coalesce(c, F.lit("")), ":", 1)
    both = F.size(F.array_union(a, b))
    overlap = F.when(both == 0, (F.col("ref_ok") & F.col("cand_ok")).cast("double")).otherwise(F.size(F.array_intersect(a, b)) / both)
    return runs.select("pair_id", (F.col("ref_ok") == F.col("cand_ok")).alias("ok_match"), (kind("ref_error") == kind("cand_error")).alias("error_match"), overlap.alias("stdout_overlap"), T.ratio(F.least("ref_seconds", "cand_seconds"), F.greatest("ref_seconds", "cand_seconds")).alias("duration_ratio"))
