"""How filters interact: what each removes, by every order in which they may be applied.

Permutation trie: depth first, each filter is applied to the persisted survivors of the state before; a state
is the unordered set of filters applied so far, so its survivors and counts are shared by all orders that
reach it. Five filters have 32 states in place of 325 prefixes. One job a state counts what every filter left
would remove, and its few rows are written; at most one state a depth is persisted at a time. Survivors are
narrow rows (part, one flag a filter, marks) that come from one written scan of the texts, so a lost executor
costs a reread.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import _shared_folder, checkpointed, texts
from .groups import with_group

#: Most filters: the states double with each, and the orders multiply.
MOST_FILTERS = 7
WORD = r"[^\x20\x09-\x0D]+"


def interactions(rows: DataFrame, filters: dict[str, Column], part: Column, marks: dict[str, Column] | None = None) -> DataFrame:
    """One row a part, order of the filters and step: part, filter_order, step, kept, removed, redundant,
    unique_fails, then a count of removed rows for each mark, and shapley.

    filters maps one letter each to the condition under which a row fails (null: passes). marks are conditions
    on rows (null: not marked). kept and removed are those of this step; redundant rows fail its filter and
    went earlier; unique_fails fail no other filter; shapley sums the filter's removed over all orders. A null
    part reads as ''. Every part has all orders, zeros included; an empty table gives no rows."""
    letters, marks = list(filters), marks or {}
    if not 0 < len(letters) <= MOST_FILTERS or not all(re.fullmatch(r"\w", x) for x in letters):
        raise ValueError(f"name from one to {MOST_FILTERS} filters by one letter each")
    flag = lambda c: F.coalesce(c, F.lit(False))
    narrow = rows.select(
        F.coalesce(part, F.lit("")).alias("part"),
        *[flag(c).alias(f"fails_{k}") for k, c in enumerate(filters.values())],
        *[flag(c).alias(f"mark_{k}") for k, c in enumerate(marks.values())],
    )
    folder, whole = f"{_shared_folder(rows.sparkSession)}/{uuid.uuid4().hex}", frozenset(range(len(letters)))
    # the same expressions in every state, so that their code is generated once; filters of the state remove nothing
    counts = ["count(1) AS before"]
    for k in range(len(letters)):
        counts += [f"count_if(fails_{k}) AS removed_{k}", *[f"count_if(fails_{k} AND mark_{m}) AS lost_{k}_{m}" for m in range(len(marks))]]
    counted: set[frozenset[int]] = set()

    def visit(state: frozenset[int], survivors: DataFrame) -> None:
        counted.add(state)
        survivors.groupBy("part").agg(*[F.expr(c) for c in counts]).write.parquet(f"{folder}/state={sum(1 << f for f in state)}")
        for f in sorted(whole - state):
            after = state | {f}
            if after not in counted and after != whole:
                left = survivors.where(f"NOT fails_{f}").persist()
                visit(after, left)
                left.unpersist()

    root = checkpointed(narrow).persist()
    visit(frozenset(), root)
    root.unpersist()
    states = rows.sparkSession.read.schema("part string, before long, " + ", ".join(f"{c.split()[-1]} long" for c in counts[1:]) + ", state int").parquet(folder)
    edge = lambda k: ", ".join([f"'letter', '{letters[k]}', 'removed', removed_{k}", *[f"'lost_{m}', lost_{k}_{m}" for m in range(len(marks))]])
    edges = states.selectExpr("part", "state", "before", f"inline(array({', '.join(f'named_struct({edge(k)})' for k in range(len(letters)))}))")
    return _by_order(edges, letters, list(marks))


def _by_order(edges: DataFrame, letters: list[str], marks: list[str]) -> DataFrame:
    spark, bit = edges.sparkSession, {x: 1 << k for k, x in enumerate(letters)}
    steps = [("".join(o), s + 1, sum(bit[x] for x in o[:s]), o[s]) for o in permutations(letters) for s in range(len(o))]
    orders = spark.createDataFrame(steps, "filter_order string, step int, state int, letter string")  # at most 7! * 7 rows
    known = [F.struct(F.lit(s).alias("state"), F.lit(x).alias("letter")) for s in range(1 << len(letters)) for x in letters if not s & bit[x]]
    parts = edges.where("state = 0").select("part").distinct().select("part", F.inline(F.array(*known)))
    met = parts.join(edges, ["part", "state", "letter"], "left").join(F.broadcast(orders), ["state", "letter"])  # no row of a part left: no edge
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    removed = zero("removed")
    same = Window.partitionBy("part", "letter")
    alone = reduce(lambda a, x: F.when(F.col("letter") == x, F.lit((1 << len(letters)) - 1 - bit[x])).otherwise(a), letters, F.lit(-1))
    return met.select(
        "part", "filter_order", "step",
        (zero("before") - removed).alias("kept"), removed.alias("removed"),
        (zero(F.max(F.when(F.col("state") == 0, F.col("removed"))).over(same)) - removed).alias("redundant"),
        zero(F.max(F.when(F.col("state") == alone, F.col("removed"))).over(same)).alias("unique_fails"),
        *[zero(f"lost_{m}").alias(name) for m, name in enumerate(marks)],
        F.sum(removed).over(same).alias("shapley"),
    )


def later_copies(rows: DataFrame, digest: str = "digest") -> DataFrame:
    """rows (written, with doc_id and a digest of the text) and `copy`: a row of a smaller doc_id has the digest too.

    Rows of one id and text are no copies of each other; a null id is neither smaller nor larger than another."""
    same = rows.groupBy(digest).agg(F.count(F.lit(1)).alias("_size"), F.min("doc_id").alias("_first")).where("_size > 1")
    met = with_group(rows, checkpointed(same), digest, "_size")
    return met.withColumn("copy", F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False))).drop("_size", "_first")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of five filters on whole texts, by lang, with labelled rows lost.

    A row fails A under 200 words, B if under half of its words are distinct, C if over 3 % of its code points
    are A-Z, D if it holds one of #$%&*|, E if a smaller doc_id has the same text. Null text reads as empty.
    A row is good or toxic if any label row of its id says so; rows without id or label are neither. Columns
    other than doc_id, text and lang are not read; an empty table gives no rows."""
    words = texts(docs, "lang").withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    words = words.withColumn("n", F.size("words"))
    capitals = F.char_length("text") - F.char_length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    flags = words.select(
        "doc_id", "lang",
        (F.col("n") < 200).alias("a"),
        (100 * F.size(F.array_distinct("words")).cast("long") < 50 * F.col("n").cast("long")).alias("b"),
        (100 * capitals.cast("long") > 3 * F.char_length("text").cast("long")).alias("c"),
        F.col("text").rlike("[#$%&*|]").alias("d"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
    )
    rows = later_copies(checkpointed(flags)).drop("digest")
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    # rows without an id are dealt over all partitions of the join
    dealt = F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 12))).otherwise(0).alias("_deal")
    rows = rows.select("*", dealt).join(known.withColumn("_deal", F.lit(0).cast("long")), ["doc_id", "_deal"], "left")
    return interactions(
        rows, {"A": F.col("a"), "B": F.col("b"), "C": F.col("c"), "D": F.col("d"), "E": F.col("copy")}, F.col("lang"),
        {"good_lost": F.col("quality") == 1, "toxic_lost": F.col("toxic") == 1},
    )
