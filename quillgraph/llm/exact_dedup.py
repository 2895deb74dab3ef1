"""Exact copies of documents by progressive refinement: length, then a hash of the beginning, then a hash of all.

One scan counts the rows of each (length, beginning); a row alone there has no copy and its content is not
hashed. A second scan hashes the whole text of the others and writes one narrow row a document, on which the
rest works: no text is shuffled while the repeated beginnings fit a broadcast of a bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .groups import with_group

#: Code points of the beginning that the second level hashes.
PREFIX = 64


def refined(rows: DataFrame) -> DataFrame:
    """rows (with text) and `full`: SHA-256 of the text where another row has its length and beginning, else null."""
    opening = F.xxhash64(F.octet_length("text"), F.left("text", F.lit(PREFIX)))
    rows = rows.withColumn("_opening", opening)
    openings = checkpointed(rows.groupBy("_opening").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1"))
    met = with_group(rows, openings, "_opening", "_rows")
    return met.withColumn("full", F.when(F.col("_rows").isNotNull(), F.unhex(F.sha2("text", 256)))).drop("_opening", "_rows")


def exact_copies(docs: DataFrame, *carried: Column) -> DataFrame:
    """doc_id, keep_id, group_size, kept of every row, then the carried expressions over the columns of docs.

    Equal texts are one group; of a group the row with the largest doc_id stays (kept), a null id counting as
    the least. Of rows that share both text and id exactly one is kept, which one is not defined. Null text
    reads as empty, and empty texts are equal. An empty table gives no rows. Columns of docs beyond doc_id and
    text are read only where carried names them, so their names cannot clash."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.struct(F.lit(0).alias("_"), *carried).alias("carried")
    )
    narrow = refined(rows).select("doc_id", F.octet_length("text").alias("length"), "full", "carried", F.monotonically_increasing_id().alias("row"))
    narrow = checkpointed(narrow)  # the numbers in `row` are fixed by being written
    same = narrow.where("full is not null").groupBy("full").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("last"))
    met = with_group(narrow, checkpointed(same.where("group_size > 1")), "full", "group_size")
    alone = F.col("group_size").isNull()
    return met.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("last.row"))).alias("kept"),
        *[F.col("carried")[f].alias(f) for f in narrow.schema["carried"].dataType.names[1:]],
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_copies keeps, unchanged: null texts stay null, all columns stay as they are."""
    whole = exact_copies(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole"))
    return whole.where("kept").select(*[F.col("_whole")[c].alias(c) for c in docs.columns])
