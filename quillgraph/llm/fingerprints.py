"""Canonical exact digests of documents, with Spark functions only.

canonical(text): NFKC, full case folding, NFKC again, each run of white space one space, trimmed.
The fingerprint is a 128-bit xxhash of that. Rows of one fingerprint are compared byte by byte; where
two different canonical texts share one, each gets a suffix of its own, so equal fingerprints mean
equal canonical texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, texts

#: Text bytes in one range of doc_id, and the most ranges: what is broadcast is one row a range.
RANGE_BYTES, MOST_RANGES = 4 << 20, 1 << 16
#: Most fingerprints of repeated buckets that are broadcast (about 50 bytes each); more are joined by shuffle.
MOST_BROADCAST = 1 << 18


def canonical(text: Column) -> Column:
    nfkc = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True))
    return F.trim(F.regexp_replace(nfkc(folded), r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    """128 bits as 32 hex digits: xxhash64 under two seeds."""
    part = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat(part(F.xxhash64(canon)), part(F.xxhash64(F.lit(0x5851F42D4C957F2D), canon)))


def _ranges(docs: DataFrame) -> tuple[Column, int]:
    """(range number of a doc_id, how many): ranges of about RANGE_BYTES, found by two short searches."""
    size, low = docs.agg(F.sum(F.octet_length("text")), F.min("doc_id")).first()
    n = min(MOST_RANGES, max(1, math.ceil((size or 0) / RANGE_BYTES)))
    if n == 1 or low is None:
        return F.lit(0), 1
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0]
    cuts = sorted(set(cuts))
    width = math.isqrt(len(cuts)) + 1
    rows = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    below = lambda bounds: F.size(F.filter(bounds, lambda c: c <= F.col("doc_id")))
    row = F.greatest(below(F.array(*[F.lit(r[0]).cast("long") for r in rows])), F.lit(1))
    fine = F.element_at(F.array(*[F.array(*[F.lit(c).cast("long") for c in r]) for r in rows]), row)
    return (row - 1) * width + below(fine), len(cuts) + 1


def with_next(docs: DataFrame) -> DataFrame:
    """Adds next_text and next_digest: of the row that follows by descending doc_id; the first follows the last.

    One shuffle by ranges of doc_id. The first row of each range goes to the range before as well."""
    number, n = _ranges(docs)
    ranged = docs.withColumn("_range", number.cast("int"))
    heads = ranged.groupBy("_range").agg(F.max("doc_id").alias("_head"))  # at most n <= MOST_RANGES rows
    order = Window.orderBy(F.desc("_range"))
    heads = heads.select(F.col("_head"), F.coalesce(F.lag("_range").over(order), F.min("_range").over(Window.partitionBy())).alias("_before"))
    at = F.array(F.struct(F.col("_range").alias("at"), F.lit(False).alias("guest")), F.struct(F.col("_before").alias("at"), F.lit(True).alias("guest")))
    dealt = ranged.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("_head")), "left")
    dealt = dealt.withColumn("_to", F.explode(F.filter(at, lambda x: x["at"].isNotNull()))).select(*docs.columns, "_to.at", "_to.guest")
    by = Window.partitionBy("at").orderBy("guest", F.col("doc_id").desc_nulls_last(), "digest", "text")
    led = dealt.select("*", F.lead("text").over(by).alias("next_text"), F.lead("digest").over(by).alias("next_digest"))
    return led.where(~F.col("guest")).drop("at", "guest")


def colliding(docs: DataFrame) -> DataFrame:
    """digest, canon, suffix of canonical texts that share a digest with another one (normally none).

    Only digests of several rows are compared; their texts meet as the least and the greatest of each
    digest, which are combined before the shuffle, so copies of one text cost a row a partition."""
    counts = docs.groupBy("digest").count().where("count > 1").select("digest")
    repeated = checkpointed(counts)
    small = repeated.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    rows = docs.join(F.broadcast(repeated) if small else repeated, "digest", "left_semi").select("digest", canonical(F.col("text")).alias("canon"))
    ends = rows.groupBy("digest").agg(F.min("canon").alias("a"), F.max("canon").alias("b"))
    unequal = checkpointed(ends.where("a <> b").select("digest"))
    if unequal.isEmpty():
        return unequal.select("digest", F.lit("").alias("canon"), F.lit("").alias("suffix"))
    kinds = rows.join(unequal, "digest", "left_semi").distinct()
    return kinds.withColumn("suffix", F.concat(F.lit("-"), F.row_number().over(Window.partitionBy("digest").orderBy("canon")).cast("string")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, digest, text, next_text, next_digest, fingerprint of every row; see edited() for comparisons.

    Null text reads as empty. Null ids come last in the order; rows of one id are ordered by digest and
    text. An empty table gives an empty result."""
    base = texts(docs).withColumn("digest", digest(canonical(F.col("text"))))
    rows = with_next(base)
    clash = colliding(base)
    if clash.isEmpty():
        return rows.withColumn("fingerprint", F.col("digest"))
    own = rows.withColumn("canon", canonical(F.col("text"))).join(clash, ["digest", "canon"], "left")
    return own.withColumn("fingerprint", F.concat("digest", F.coalesce("suffix", F.lit("")))).drop("canon", "suffix")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """The contract's comparison with an edited text: its last third replaced by the start of the next document."""
    rows = fingerprints(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left("text", (F.col("n_chars") - third).cast("int")), F.left("next_text", third)))
    rows = rows.withColumn("edited_digest", digest(canonical(F.col("edited"))))
    same = lambda h, t: F.when((F.col("digest") == F.col(h)) & (canonical(F.col("text")) == canonical(F.col(t))), 1.0).otherwise(0.0)
    near_edited, near_next = same("edited_digest", "edited"), same("next_digest", "next_text")
    edited_fp = F.when(near_edited == 1.0, F.col("fingerprint")).otherwise(F.when(F.col("edited_digest") == F.col("digest"), F.concat("edited_digest", F.lit("-e"))).otherwise(F.col("edited_digest")))
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), "fingerprint", edited_fp.alias("edited_fingerprint"), near_edited.alias("near_edited"), near_next.alias("near_next"))
