"""Transitive closure: which nodes reach which, over one or more edges. Sets, so cycles end."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rounds double the path length, so this many cover any path that fits in a cluster.
MOST_ROUNDS = 48
#: A table of more rows is not sent whole to the driver and to each executor. Files are packed, so their bytes, which plan
#: joins, may be a thirtieth of what is held.
MOST_SENT = 65_536


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a session that names none gets one of its own only in local mode."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillgraph-checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage by a table written to the shared folder; its true size plans later joins."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """A table of so many rows, as joins should take it: a large one is dealt out by its keys, never broadcast."""
    return df.hint("merge") if rows > MOST_SENT else df


def transitive(edges: DataFrame, source: str = "src", target: str = "dst", within: str | None = None) -> DataFrame:
    """Distinct (source, target) joined by at least one edge, per value of the column `within` if given.

    Each round joins the pairs found last with all found so far, which doubles the length covered. A
    node that is on a cycle reaches itself; without edges the result is empty."""
    keys = [within] if within else []
    reach = checkpointed(edges.select(*keys, source, target).where(F.col(source).isNotNull() & F.col(target).isNotNull()).distinct())
    fresh, all_rows = reach, reach.count()
    rows = all_rows
    for _ in range(MOST_ROUNDS):
        known, last = dealt(reach, all_rows), dealt(fresh, rows)
        longer = last.withColumnRenamed(target, "_mid").join(known.withColumnRenamed(source, "_mid"), [*keys, "_mid"]).select(*keys, source, target)
        before = known.withColumnRenamed(target, "_mid").join(last.withColumnRenamed(source, "_mid"), [*keys, "_mid"]).select(*keys, source, target)
        new = checkpointed(longer.union(before).distinct().join(known, [*keys, source, target], "left_anti"))
        rows = new.count()
        if not rows:
            return reach
        reach, all_rows = reach.union(new), all_rows + rows  # a table a round; their number is the logarithm of the longest path
        fresh = new
    raise RuntimeError(f"no fixpoint in {MOST_ROUNDS} rounds")
