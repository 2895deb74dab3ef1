"""Rows joined to one row of their group, where a group may hold any share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups that are broadcast whole (tens of bytes each); with more of them only hot ones are.
MOST_BROADCAST = 1 << 20
#: A group is hot if it holds at least one in HOT of the grouped rows, so there are at most HOT of them.
HOT = 1 << 12


def with_group(rows: DataFrame, groups: DataFrame, key: str, size: str, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """rows, each with the columns of the one row of groups that has its key, else nulls (left join).

    groups is a written table; its column size counts the rows of each key. Up to most_broadcast groups are
    broadcast. Beyond that the hot ones are, which their share of the rows bounds to HOT; the others meet by
    a shuffle in which no key has more than one in HOT of the grouped rows, and rows of hot or null keys are
    dealt over all its partitions. Repeated rows stay repeated; an empty side gives nulls or no rows."""
    n, total = groups.agg(F.count(F.lit(1)), F.sum(size)).first()
    if n <= most_broadcast:
        return rows.join(F.broadcast(groups), key, "left")
    others = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) * HOT >= total).select(key, F.struct(*others).alias("_hot"))
    light = groups.where(F.col(size) * HOT < total).select(key, F.lit(0).alias("_deal"), F.struct(*others).alias("_light"))
    dealt = 1 + F.pmod(F.monotonically_increasing_id(), F.lit(HOT)).cast("int")
    met = rows.join(F.broadcast(hot), key, "left")
    met = met.withColumn("_deal", F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), 0).otherwise(dealt))
    met = met.join(light, [key, "_deal"], "left").withColumn("_own", F.coalesce("_hot", "_light"))
    return met.select(*rows.columns, *[F.col("_own")[c].alias(c) for c in others])
