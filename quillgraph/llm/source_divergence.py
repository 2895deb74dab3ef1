"""Which terms, and which pairs of sources, set the sources of a language apart.

Plain relational: matches of the term pattern are exploded and counted by (lang, source, term); the kept
vocabulary of a language is crossed with its groups, so that absent terms count zero; the dense rows meet
themselves on (lang, term), are summed by pair and ranked by windows.

Counts of one term in all sources travel as one row, so the dense rows are made where that row is and the
self-join needs no shuffle of its own. All arithmetic is on whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (lang, source) groups that are broadcast (tens of bytes each); more of them are joined by a dealt shuffle.
MOST_GROUPS, DEALS = 1 << 16, 1 << 8


def term_counts(docs: DataFrame, pattern: str = TERM) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that hold it). Null text, lang and source read as ''."""
    clean = lambda c: F.coalesce(c, F.lit("")).alias(c)
    terms = F.sort_array(F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(pattern), F.lit(0)))
    rows = docs.select(clean("lang"), clean("source"), terms.alias("terms"))
    # each term beside the one before it: the first of a run of equal terms stands for its document
    pairs = rows.select("lang", "source", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.concat(F.array(F.lit("")), "terms").alias("before"))))
    first = (F.col("term") != F.col("before")).cast("long")
    return pairs.where("term is not null").groupBy("lang", "source", "term").agg(F.count(F.lit(1)).alias("n"), F.sum(first).alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int = 3) -> DataFrame:
    """lang, term, n, by_source (map of the sources that hold the term to n) of terms in at least least_docs documents."""
    by = F.map_from_entries(F.collect_list(F.struct("source", "n")))
    return counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), by.alias("by_source")).where(F.col("docs") >= least_docs).drop("docs")


def share(n: Column, total: Column, vocabulary: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + vocabulary)), in three steps of a thousand that stay within a long."""
    below, q, r = total + vocabulary, F.lit(0).cast("long"), n + 1
    for _ in range(3):
        r = r * 1000
        q, r = q * 1000 + _whole(r, below), r % below
    return q + 1


def _whole(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most 10^9 + 1, so the square is within a long."""
    return _whole((p - q) * (p - q), q)


def _by_lang(kept: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """Each kept term once for every group of its language."""
    if n_groups <= MOST_GROUPS:
        return kept.join(F.broadcast(groups), "lang")
    dealt = kept.withColumn("_deal", F.pmod(F.xxhash64("term"), F.lit(DEALS)))
    copies = groups.withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long"))))
    return dealt.join(copies, ["lang", "_deal"]).drop("_deal")


def source_divergence(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair`: every other source of the language, by the summed excess of this source's shares over its
    shares (0 where the language keeps no term), all ranks. Part `term`: the terms that the source uses more
    than its language does, by their excess, ranks to `top`. Ranks go by value descending, then item by bytes.
    Null text, lang and source read as ''; rows of one id are documents of their own; a language with one
    source has no pairs, a group without terms no terms; an empty table gives no rows. Only text, lang and
    source are read."""
    kept = checkpointed(kept_terms(term_counts(docs), least_docs))
    clean = lambda c: F.coalesce(c, F.lit("")).alias(c)
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("lang_total"))
    totals = kept.select("lang", F.explode("by_source").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(clean("lang"), clean("source")).distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = checkpointed(groups.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "v", "lang_total")]))
    n_groups = groups.count()

    dealt = kept.repartition("lang", "term")
    dense = _by_lang(dealt, groups, n_groups).withColumn("own", F.coalesce(F.col("by_source")[F.col("source")], F.lit(0).cast("long")))
    dense = dense.withColumn("p", share(F.col("own"), F.col("total"), F.col("v")))
    left, right = dense.select("lang", "term", "source", "p"), dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    sums = left.join(right, ["lang", "term"]).where("source <> item").groupBy("lang", "source", "item").agg(F.sum(excess(F.col("p"), F.col("q"))).alias("value"))
    others = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = others.join(sums, ["lang", "source", "item"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))

    q = share(F.col("n"), F.col("lang_total"), F.col("v"))
    used = dense.where("own > 0").withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), excess(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    shape = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank)
    return shape(pairs, "pair").union(shape(used, "term").where(F.col("rank") <= top))
