"""Mixing sources to target weights over fixed-length blocks of tokens, with Spark functions only.

Words of a source form one stream (documents in a pseudorandom order), cut into blocks of
block_words. Output slots are numbered; a permutation of the slot numbers deals them to sources, so
the source counts of each shard are a multinomial draw held to the totals that the targets ask for.
The k-th slot of a source takes block perm(k mod n) of its n blocks, with one permutation for each
pass over the source, so no block is used more than once more often than another. Permutations are
keyed Feistel networks evaluated on the index alone: no sort, no state, the same on every rerun.

Scale: running sums go over chunks of about CHUNK_DOCS documents, so a source that holds a third of
all rows is dealt over many tasks; slots are made in runs of RUN by whoever holds the run; blocks and
slots meet by a shuffle on (source, block), where a key has at most `most` slots: hints say so, since
Spark does not see that a few rows of sources make many slots. Sources are numbered and summed up by
ranges of their names, so they need not fit in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed

WORD = r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"
SPACE = r"[\x20\x09-\x0D]++"
CHUNK_DOCS, RUN = 4096, 1 << 13
#: Sources (distinct names) whose table is broadcast; more are joined by shuffle.
MOST_BROADCAST = 20_000


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]++", "")


def word_count(text: Column) -> Column:
    return F.length(F.regexp_replace(_bare(text), WORD, "x")).cast("long")


def permuted(df: DataFrame, out: str, index: str, n: str, key: str) -> DataFrame:
    """Adds `out`: a permutation of 0..n-1 applied to `index`, keyed by the column `key`.

    Four Feistel rounds permute the next domain of an even number of bits, under 4 n; a value outside
    0..n-1 is permuted again until it falls inside. That takes under 4 steps on average; the second
    loop runs only where 24 were too few, and a value still outside after it raises an error."""
    feistel = (
        "aggregate(sequence(0, 3), named_struct('l', shiftright({x}, _half), 'r', {x} & _mask),"
        " (s, i) -> named_struct('l', s.r, 'r', s.l ^ (xxhash64(_key, i, s.r) & _mask)), s -> shiftleft(s.l, _half) | s.r)"
    )
    walk = "aggregate(sequence(1, {m}), {start}, (x, k) -> if(x < {n}, x, " + feistel.format(x="x") + "))"
    df = df.withColumn("_half", F.expr(f"greatest(cast(ceil(log2(greatest(cast({n} as double), 2.0D)) / 2) as int), 1)"))
    df = df.withColumn("_mask", F.expr("shiftleft(1L, _half) - 1")).withColumn("_key", F.col(key))
    df = df.withColumn("_p", F.expr(walk.format(m=24, n=n, start=feistel.format(x=index))))
    df = df.withColumn("_p", F.expr(f"if(_p < {n}, _p, {walk.format(m=4096, n=n, start='_p')})"))
    return df.withColumn(out, F.expr(f"if(_p < {n}, _p, cast(raise_error('permutation did not end') as bigint))")).drop("_half", "_mask", "_key", "_p")


def _running(df: DataFrame, value: Column, order: Column, name: str) -> DataFrame:
    """Adds `name`: the sum of value over the rows before, where `part` numbers ranges of that order."""
    own = Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy("part").agg(F.sum(value).alias("_sum"))  # a row a partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    rows = df.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0))).join(F.broadcast(parts), "part")
    return rows.withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_own", "_before")


def source_table(sized: DataFrame, weights: tuple[int, ...], most: int, block_words: int) -> tuple[DataFrame, int]:
    """source, source_size, n_docs, target, n_blocks, n_slots, first_slot, n_slots_all of each source; and their number.

    Targets: each source's share of all words by weight (weights repeat over sources in code point
    order, null last), at most `most` times its size, the excess reshared. With level L a source gets
    least(most * size, weight * L); L rises until the targets add up to all words."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    name = F.col("source").asc_nulls_last()
    sums = _running(checkpointed(sums.repartitionByRange(name).withColumn("part", F.spark_partition_id())), F.lit(1), name, "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sums = checkpointed(sums.withColumn("weight", weight))
    total, n = sums.agg(F.sum("source_size"), F.count(F.lit(1))).first()
    level = 0.0
    while total:
        held = F.col("source_size") * most < F.col("weight") * F.lit(level)
        left, share = sums.agg(F.lit(float(total)) - F.sum(F.when(held, F.col("source_size") * most).otherwise(0)), F.sum(F.when(held, 0.0).otherwise(F.col("weight")))).first()
        if not share or left / share <= level * (1 + 1e-15):
            break
        level = left / share
    target = F.least((F.col("source_size") * most).cast("double"), F.col("weight") * F.lit(level))
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    slots = F.least(F.round(F.col("target") * F.col("n_blocks") / F.greatest("source_size", F.lit(1))).cast("long"), F.col("n_blocks") * most)
    made = sums.withColumn("target", target).withColumn("n_blocks", blocks).withColumn("n_slots", slots)
    made = checkpointed(_running(made, F.col("n_slots"), F.col("rank").asc(), "first_slot"))
    every = made.agg(F.sum("n_slots")).first()[0] or 0
    return checkpointed(made.withColumn("all_slots", F.lit(every).cast("long")).drop("part")), n


def _joined(df: DataFrame, sources: DataFrame, n: int, *columns: str) -> DataFrame:
    named = sources.select(F.col("source").alias("_source"), *columns)
    return df.join(F.broadcast(named) if n <= MOST_BROADCAST else named, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def _offsets(sized: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """Adds `off`: words of the source before the document, in the order of (chunk, doc_id, size, a hash of the text)."""
    rows = _joined(sized, sources, n, "rank", "source_size", "target", "n_docs")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size"), F.ceil(F.col("n_docs") / CHUNK_DOCS)).cast("long"))
    within = Window.partitionBy("rank", "chunk").orderBy("doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    ends = sized.select("doc_id", "source", "size")
    ends = _joined(ends, sources, n, "rank", "n_docs").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size"), F.ceil(F.col("n_docs") / CHUNK_DOCS)).cast("long"))
    ends = ends.groupBy("rank", "chunk").agg(F.sum("size").alias("chunk_size"))
    before = Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("rank", "chunk", F.coalesce(F.sum("chunk_size").over(before), F.lit(0)).alias("outer"))
    return rows.join(ends, ["rank", "chunk"]).withColumn("off", F.col("inner") + F.col("outer")).drop("inner", "outer", "chunk", "n_docs")


def slots(sources: DataFrame, seed: int, shard_slots: int) -> DataFrame:
    """rank, k, block, slot, shard: one row for each output slot, made in runs of RUN."""
    runs = sources.where("n_slots > 0").select("rank", "n_blocks", "n_slots", "first_slot", "all_slots", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_slots") - 1) / RUN))).alias("run"))
    parts = math.ceil((sources.agg(F.max("all_slots")).first()[0] or 0) / RUN)
    runs = runs.repartition(max(1, parts), "rank", "run")  # a given number: small rows here, but each makes RUN more
    rows = runs.withColumn("k", F.explode(F.expr(f"sequence(run * {RUN}, least(run * {RUN} + {RUN - 1}, n_slots - 1))"))).drop("run")
    rows = rows.withColumn("again", F.expr("k div n_blocks")).withColumn("at", F.expr("k % n_blocks")).withColumn("place", F.expr("first_slot + k"))
    rows = rows.withColumn("bk", F.xxhash64(F.lit(seed), "rank", "again")).withColumn("sk", F.lit(seed).cast("long"))
    rows = permuted(permuted(rows, "block", "at", "n_blocks", "bk"), "slot", "place", "all_slots", "sk")
    return rows.select("rank", "k", "block", "slot", F.expr(f"slot div {shard_slots}").alias("shard"))


def _pieces(docs: DataFrame, block_words: int) -> DataFrame:
    """One row for each block that a document of some size is in, with the words of it that are there."""
    rows = docs.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(off div {block_words}, (off + size - 1) div {block_words})")))
    rows = rows.withColumn("lo", F.greatest(F.col("off"), F.col("block") * block_words))
    return rows.withColumn("words", F.least(F.expr("off + size"), (F.col("block") + 1) * block_words) - F.col("lo"))


def _plan(docs: DataFrame, weights: tuple[int, ...], most: int, block_words: int, *more: str) -> tuple[DataFrame, DataFrame, int]:
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"), *more)
    sources, n = source_table(sized.select("doc_id", "source", "size"), weights, most, block_words)
    return sized, sources, n


def mix_counts(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block_words: int = 128, shard_slots: int = 1024, seed: int = 20) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted) of every row.

    Null text has no words; such rows stay, with taken 0. A null source is a source, last in order.
    Repeated rows and ids are documents of their own. An empty table gives an empty result. Other
    columns are not read."""
    sized, sources, n = _plan(docs, weights, most, block_words)
    placed = _offsets(sized, sources, n)
    used = slots(sources, seed, shard_slots).groupBy("rank", "block").agg(F.count(F.lit(1)).alias("uses"))
    taken = _pieces(placed, block_words).join(used.hint("merge"), ["rank", "block"], "left")
    keys = ["rank", "off", "doc_id", "size", "source_size", "target"]
    full = taken.groupBy(*keys).agg(F.coalesce(F.sum(F.col("words") * F.col("uses")), F.lit(0)).cast("long").alias("taken"))
    none = _joined(sized.where("size = 0"), sources, n, "source_size", "target").withColumn("taken", F.lit(0).cast("long"))
    out = ["doc_id", "size", "source_size", "target", "taken"]
    return full.select(*out).unionByName(none.select(*out))


def mix_blocks(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block_words: int = 128, shard_slots: int = 1024, seed: int = 20) -> DataFrame:
    """The mix itself: shard, slot, source, doc_ids, n_words, text of each output block.

    Blocks hold words of neighbouring documents of one source, joined by a space. Rows without words
    give nothing. See mix_counts for nulls, repeated rows and empty tables."""
    sized, sources, n = _plan(docs, weights, most, block_words, F.col("text"))
    pieces = _pieces(_offsets(sized, sources, n), block_words)
    said = F.array_join(F.slice(F.split(_bare(F.col("text")), SPACE), (F.col("lo") - F.col("off") + 1).cast("int"), F.col("words").cast("int")), " ")
    pieces = pieces.select("rank", "source", "block", F.struct("lo", "doc_id", said.alias("said"), "words").alias("piece"))
    blocks = pieces.groupBy("rank", "block").agg(F.first("source").alias("source"), F.array_sort(F.collect_list("piece")).alias("pieces"))
    rows = slots(sources, seed, shard_slots).join(blocks.hint("merge"), ["rank", "block"])
    return rows.select("shard", "slot", "source", F.expr("pieces.doc_id").alias("doc_ids"), F.expr("aggregate(pieces, 0L, (a, p) -> a + p.words)").alias("n_words"), F.array_join(F.expr("pieces.said"), " ").alias("text"))
