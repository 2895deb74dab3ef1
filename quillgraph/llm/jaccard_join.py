"""Exact Jaccard components by a metric-space join of shingle sets.

1 - |x & y| / |x | y| is a metric. A link is a distance of at most EPS = 0.2, so of x's shingles at
most |x| / 5 are not in a linked y.

Open sets. Pivots tell nothing about unrelated texts, which are all at distance 1 of each other. So
first, a set goes if more than a fifth of its shingles are in no other set: it has no link. A block
of documents asks shards which of its shingles are in other sets as well; for sets of SMALL shingles
and more only those in the lowest ASKED of the hash space, which can keep a set too many and loses none.

Regions. Order all shingles by the number of open sets that have them. x and a linked y share one of
their |x| / 5 + 1 and |y| / 5 + 1 rarest; who shares a shingle forms a region. At the first shingle
that the two share, with i and j before it, |x & y| <= min(|x| - i, |y| - j) =: min(room), and a link needs
9 |x & y| >= 4 (|x| + |y|). So a region has to join only pairs whose rooms allow this. A member is wide
if it could fit one of its own size, 9 room >= 8 |x|; of a pair that fits one is wide.

Rounds. Regions recur until none has members of two components. In the first round each region
compares its pivot, the member that shares most with others, to the rest; what is linked has one
label from then on, and a group of any size costs about one pair a member. Later a region of at most
LEAF members compares its pairs of unlike labels that fit. A larger one is split: k wide pivots (2, 4,
8, ...) measure all members; a member belongs to the Voronoi cell of the nearest pivot within 2 EPS, or to
the far rest, and by the triangle inequality is a guest in every cell whose pivot p has d(p) <=
min(3 EPS, d(nearest) + 2 EPS). Every link lies in some cell or in the rest, pairs of guests need not be
compared, and the pivots are done. Where the cells would hold over 1.5 times the members, the region
goes on whole, without its pivots.

Equal sets are one class, named by a hash of the set's digest that is checked to be its own, so rows
that share an id or have none are told apart by their texts. Components come from the links by
contracting labels in rounds.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from .common import Words, block_count, block_of, checkpointed, mix, slices, string_buffers, texts, windows
from .messages import bits, by_shard, flags, large, pack, small, unpack

BLOCK_BYTES, SHARD_KEYS, SHINGLE = 4 << 20, 2_000_000, 5
#: Sets of under SMALL shingles are tried by all of them, others by those in the lowest ASKED of the hash space.
SMALL, ASKED = 64, 0.375
#: Members of a region that looks at its pairs directly, to measure those that fit.
LEAF = 4096
#: Comparisons with one set that meet in one place; a set with more is dealt to several.
HUB = 4096
#: Most rows of two numbers that are broadcast.
MOST_BROADCAST = 1 << 18
SLACK = 1e-9


def shingle_set(h: np.ndarray) -> np.ndarray:
    if not len(h):
        return np.zeros(0, np.uint64)
    n = min(SHINGLE, len(h))
    return np.unique(mix(windows(h, n) ^ np.uint64(n)))


def _sets(column: pa.Array) -> list[np.ndarray]:
    data, offsets = string_buffers(column)
    out = []
    for i, j, d, o in slices(data, offsets):
        w = Words(d, o, lower=True)
        out += [shingle_set(w.hash[w.offsets[k] : w.offsets[k + 1]]) for k in range(j - i)]
    return out


def _digest(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a = int(mix(s * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)) ^ len(s)
        b = int(mix(s ^ np.uint64(0x6A09E667F3BCC909)).sum(dtype=np.uint64))
    both = mix(np.array([a, b], np.uint64)).view(np.int64)
    return int(both[0]), int(both[1])


def _tried(s: np.ndarray) -> np.ndarray:
    """The shingles of a sorted set that tell whether it is open."""
    return s if len(s) < SMALL else s[: np.searchsorted(s, np.uint64(int(ASKED * (1 << 64))))]


def _asked(s: np.ndarray) -> np.ndarray:
    """Those that it asks about: all, if a set of under SMALL could be linked with it."""
    return s if len(s) * 4 <= SMALL * 5 else _tried(s)


def _counted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique(np.concatenate(parts), return_counts=True)


def _messages(block: int, n_shards: int, keys: np.ndarray, **columns) -> pa.Table:
    """A row for each shard that has some of the keys; columns make bytes of a range."""
    cuts = list(by_shard(keys, n_shards))
    out = {"shard": pa.array([c for c, _, _ in cuts], pa.int32()), "block": pa.array([block] * len(cuts), pa.int32())}
    out["keys"] = pa.array([pack(keys[i:j]) for _, i, j in cuts], pa.binary())
    return pa.table(out | {name: pa.array([f(i, j) for _, i, j in cuts], pa.binary()) for name, f in columns.items()})


def _ask_shared(n_shards: int):
    """Which shingles of the block are in more sets than one, and which are so in the block alone."""

    def run(table: pa.Table) -> pa.Table:
        seen: dict[tuple[int, int], np.ndarray] = {}
        for s in _sets(table.column("text")):
            if len(s):
                seen.setdefault(_digest(s), _asked(s))
        keys, own = _counted(list(seen.values()))
        return _messages(table.column("block")[0].as_py(), n_shards, keys, own=lambda i, j: bits(own[i:j] > 1))

    return run


def _tell_shared(table: pa.Table) -> pa.Table:
    keys = [unpack(k) for k in table.column("keys").to_pylist()]
    own = [flags(x, len(k)) for x, k in zip(table.column("own").to_pylist(), keys, strict=True)]
    u, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    shared = np.bincount(inverse, weights=np.concatenate(own) + 1, minlength=len(u)) > 1
    ends = np.cumsum([len(k) for k in keys])
    out = [bits(shared[inverse[e - len(k) : e]]) for e, k in zip(ends, keys, strict=True)]
    return pa.table({"shard": table.column("shard"), "block": table.column("block"), "shared": pa.array(out, pa.binary())})


DOCS = "doc_id long, n long, a long, b long, s array<long>"


def _open_sets(n_shards: int):
    """A row for each document, with its set if that is open and the first of its kind in the block."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        sets = _sets(table.column("text")) if table.num_rows else []
        digests = [_digest(s) for s in sets]
        first = {d: s for d, s in zip(reversed(digests), reversed(sets), strict=True) if len(s)}
        keys, _ = _counted([_asked(s) for s in first.values()])
        said = dict(zip(answers.column("shard").to_pylist(), answers.column("shared").to_pylist(), strict=True))
        shared = np.concatenate([np.zeros(0, bool), *(flags(said[c], j - i) for c, i, j in by_shard(keys, n_shards))])
        kept = []
        for s, d in zip(sets, digests, strict=True):
            tried = _tried(s)
            new = first.pop(d, None) is not None
            own = len(tried) - int(shared[np.searchsorted(keys, tried)].sum()) if new else 0
            kept.append(s.view(np.int64) if new and own <= len(s) // 5 else None)
        numbers = zip(("n", "a", "b"), ([len(s) for s in sets], [d[0] for d in digests], [d[1] for d in digests]), strict=True)
        out = {"doc_id": pa.array(table.column("doc_id").to_pylist() if sets else [], pa.int64())}
        out |= {name: pa.array(x, pa.int64()) for name, x in numbers}
        return pa.table(out | {"s": pa.array(kept, pa.list_(pa.int64()))})

    return run


def _lists(table: pa.Table) -> list[np.ndarray]:
    column = table.column("s").combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    values, ends = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    return [values[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


def _ask_counts(n_shards: int):
    def run(table: pa.Table) -> pa.Table:
        keys, own = _counted(_lists(table))
        return _messages(table.column("block")[0].as_py(), n_shards, keys, own=lambda i, j: small(own[i:j]))

    return run


def _tell_counts(table: pa.Table) -> pa.Table:
    keys = [unpack(k) for k in table.column("keys").to_pylist()]
    own = np.concatenate([large(x) for x in table.column("own").to_pylist()])
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, weights=own).astype(np.int64)
    ends = np.cumsum([len(k) for k in keys])
    out = [small(total[inverse[e - len(k) : e]]) for e, k in zip(ends, keys, strict=True)]
    return pa.table({"shard": table.column("shard"), "block": table.column("block"), "total": pa.array(out, pa.binary())})


MEMBERS = "region long, id long, n long, room long, weight long"


def _members(table: pa.Table, answers: pa.Table) -> pa.Table:
    """The regions of each set that is still open: a row for each of its rarest shingles that others have."""
    out: dict[str, list[np.ndarray]] = {c: [np.zeros(0, np.int64)] for c in ("region", "id", "n", "room", "weight")}
    sets = _lists(table) if table.num_rows else []
    keys, _ = _counted(sets)
    rows = sorted(answers.to_pylist(), key=lambda r: r["shard"])
    total = np.concatenate([np.zeros(0, np.int64), *(large(r["total"]) for r in rows)])
    for k, s in zip(table.column("id").to_pylist() if sets else [], sets, strict=True):
        n, count = len(s), total[np.searchsorted(keys, s)]
        rare = np.lexsort((s, count))[: n // 5 + 1]
        begin = int(np.searchsorted(count[rare], 1, side="right"))  # shingles before it are in no other set
        at = rare[begin:]
        full = np.full(len(at), 1, np.int64)
        for c, x in zip(out, (s[at].view(np.int64), full * k, full * n, n - np.arange(begin, len(rare)), full * int(count[at].sum())), strict=True):
            out[c].append(x)
    return pa.table({c: np.concatenate(x) for c, x in out.items()})


def _class_id(salt: int) -> Column:
    return F.xxhash64("a", "b", "n", F.lit(salt))


def _beside(df: DataFrame) -> DataFrame:
    """The small rows of df broadcast, if there are few."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def _measured(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """p, q, common, either of the pairs (id, pivot), once for each two sets; a pivot of many is dealt to several places."""
    low, high = F.least("id", "pivot"), F.greatest("id", "pivot")
    pairs = pairs.groupBy(low.alias("low"), high.alias("high")).agg(F.min("pivot").alias("q"))
    pairs = checkpointed(pairs.select((F.when(F.col("q") == F.col("low"), F.col("high")).otherwise(F.col("low"))).alias("p"), "q"))
    hubs = checkpointed(pairs.groupBy("q").count().select("q", F.ceil(F.col("count") / HUB).alias("places")).where("places > 1"))
    hubs = _beside(hubs)
    sets = sets.join(_beside(checkpointed(pairs.select(F.col("p").alias("id")).union(pairs.select("q")).distinct())), "id", "left_semi")
    x = sets.select(F.col("id").alias("p"), F.col("s").alias("x"))
    y = sets.select(F.col("id").alias("q"), F.col("s").alias("y")).join(hubs, "q", "left")
    y = y.select("q", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("places") - 1, F.lit(0).cast("long")))).alias("place"))
    pairs = pairs.join(hubs, "q", "left").select("p", "q", F.pmod(F.xxhash64("p"), F.coalesce("places", F.lit(1).cast("long"))).alias("place"))
    both = pairs.join(x.hint("merge"), "p").join(y.hint("merge"), ["q", "place"])
    both = both.select("p", "q", F.size("x").cast("long").alias("nx"), F.size("y").cast("long").alias("ny"), F.size(F.array_intersect("x", "y")).cast("long").alias("common"))
    return checkpointed(both.select("p", "q", "common", (F.col("nx") + F.col("ny") - F.col("common")).alias("either")))


def _fits(n: str, room: str) -> Column:
    """Whether the rooms of two members leave space for a link."""
    return 9 * F.least("room", room) >= 4 * (F.col("n") + F.col(n))


def _live(regions: DataFrame) -> DataFrame:
    """The members, with their number `m`, of regions with unlike labels.

    Regions of the same members become one, in which each member has the greatest of its rooms: so every
    pair that fits in one of them fits there."""
    regions = regions.withColumn("wide", F.expr("9 * room >= 8 * n"))
    could = regions.where("wide").groupBy("region").agg(F.min("n").alias("least"), F.max(F.expr("9 * room - 4 * n")).alias("most"))
    regions = regions.join(could, "region").where("wide or (9 * room >= 4 * (n + least) and 4 * n <= most)").drop("least", "most")
    marks = [F.expr(f"bit_xor(xxhash64({k}, id, guest))").alias(f"mark{k}") for k in (1, 2)]
    known = regions.groupBy("region").agg(F.count(F.lit(1)).alias("m"), (F.min("label") == F.max("label")).alias("one"), F.min("guest").alias("guests"), *marks)
    same = Window.partitionBy("mark1", "mark2", "m")
    known = known.where("not one and not guests").select("region", "m", F.min("region").over(same).alias("home"), (F.count(F.lit(1)).over(same) > 1).alias("merged"))
    rows = checkpointed(regions.join(known, "region"))
    alone = rows.where("not merged").drop("home", "merged")
    merged = rows.where("merged").groupBy(F.col("home").alias("region"), "id", "n", "label", "guest", "m").agg(F.max("room").alias("room"), F.max("weight").alias("weight"))
    return checkpointed(alone.unionByName(merged.withColumn("wide", F.expr("9 * room >= 8 * n"))))


def _cells(live: DataFrame, heads: DataFrame, measured: DataFrame, k: int) -> DataFrame:
    """The regions that remain of those with pivots: Voronoi cells with their guests, or the whole without pivots."""
    d = (1 - F.col("common") / F.col("either")).alias("d")
    there = measured.select(F.col("p").alias("id"), F.col("q").alias("pivot"), d)
    there = there.union(measured.select("q", "p", d))
    rows = live.join(heads.select("region", "pivot", "at"), "region").join(there, ["id", "pivot"], "left")
    d = F.when(F.col("id") == F.col("pivot"), -1.0).otherwise(F.coalesce("d", F.lit(1.0)))
    columns = ["region", "id", "n", "room", "weight", "label", "guest", "m"]
    one = rows.groupBy(*columns).agg(F.collect_list(F.struct(d.alias("d"), "at")).alias("all")).withColumn("best", F.array_min("all")).where("best.d >= 0")
    home = F.expr(f"if(best.d <= 0.4 + {SLACK}, best.at, -1)")
    as_guest = F.expr(f"transform(filter(all, x -> x.at <> home and x.d <= least(0.6, best.d + 0.4) + {SLACK}), x -> struct(x.at as at, true as visits))")
    child = F.concat(F.array(F.struct(F.col("home").alias("at"), F.lit(False).alias("visits"))), as_guest)
    rows = one.withColumn("home", home).withColumn("child", F.explode(child))
    size = rows.groupBy("region").agg((F.count(F.lit(1)) <= 1.5 * F.max("m")).alias("split"))
    rows = rows.join(size, "region").where("split or not child.visits")
    name = F.when(F.col("split"), F.xxhash64("region", "child.at", F.lit(k))).otherwise(F.col("region"))
    return rows.select(name.alias("region"), "id", "n", "room", "weight", "label", (F.col("guest") | (F.col("split") & F.col("child.visits"))).alias("guest"))


def links(sets: DataFrame, members: DataFrame) -> DataFrame | None:
    """p, q: enough links between classes to join every component. sets: id, s; members: as MEMBERS."""
    live = _live(members.withColumn("label", F.col("id")).withColumn("guest", F.lit(False)))
    found: list[DataFrame] = []
    k = 1
    while not live.isEmpty():
        pivot = F.max(F.struct("weight", "id", "n", "room", "label")).alias("top")
        big = live if k == 1 else live.where(F.col("m") > LEAF)
        heads = big.where("wide").groupBy("region", F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(k)).alias("at")).agg(pivot)
        heads = checkpointed(heads.select("region", "at", F.col("top.id").alias("pivot"), F.col("top.n").alias("pn"), F.col("top.room").alias("proom"), F.col("top.label").alias("plabel")))
        stars = big.join(heads, "region").where("id <> pivot")
        if k == 1:
            pairs = stars.where(_fits("pn", "proom")).select("id", "pivot")
        else:  # distances over 0.6 need not be known: sizes tell
            right = live.select("region", F.col("id").alias("pivot"), F.col("n").alias("pn"), F.col("room").alias("proom"), F.col("label").alias("plabel"), F.col("guest").alias("pguest"))
            leaves = live.where(F.col("m") <= LEAF).join(right, "region").where("id < pivot and label <> plabel and not (guest and pguest)").where(_fits("pn", "proom"))
            pairs = stars.where("10 * least(n, pn) >= 4 * greatest(n, pn)").select("id", "pivot").union(leaves.select("id", "pivot"))
        measured = _measured(sets, pairs)
        found.append(measured.where("common * 100 >= either * 80").select("p", "q"))
        rest = big.join(heads.select("region", F.col("pivot").alias("id")), ["region", "id"], "left_anti").drop("m", "wide") if k == 1 else _cells(big, heads, measured, k)
        live = _live(_relabelled(rest, live.select("id", "label").distinct(), found[-1]))
        k *= 2
    return reduce(DataFrame.union, found) if found else None


def _relabelled(rest: DataFrame, at: DataFrame, new: DataFrame) -> DataFrame:
    """The members with the labels that the new links give them; at: id, label of all whom these can link."""
    rest = checkpointed(rest)
    ends = new.join(at.toDF("p", "lp"), "p").join(at.toDF("q", "lq"), "q")
    ends = checkpointed(ends.select(F.col("lp").alias("p"), F.col("lq").alias("q")).where("p <> q").distinct())
    if ends.isEmpty():
        return rest
    roots = components(ends).select(F.col("id").alias("label"), F.col("label").alias("root"))
    return rest.join(roots, "label", "left").withColumn("label", F.coalesce("root", "label")).select(*rest.columns)


def components(edges: DataFrame) -> DataFrame:
    """id, label: the least id of the component of each end of an edge. Labels sink along edges and are followed once a round."""
    both = checkpointed(edges.union(edges.select("q", "p")).toDF("id", "to").distinct())
    labels = checkpointed(both.select("id").distinct().withColumn("label", F.col("id")))
    while True:
        said = both.join(labels.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.min("label").alias("heard"))
        new = labels.join(said, "id").select("id", "label", F.least("label", "heard").alias("next"))
        jump = new.select(F.col("id").alias("next"), F.col("next").alias("root"))
        new = checkpointed(new.join(jump, "next", "left").select("id", F.col("label").alias("old"), F.coalesce("root", "next").alias("label")))
        labels = new.select("id", "label")
        if new.where("old <> label").isEmpty():
            return labels


def _components(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Documents (doc_id, n, a, b); classes (a, b, n, label); components (label, doc_id and id of the least
    document, null ids last, and of its class); the salt of class ids."""
    base = texts(docs)
    n_blocks = block_count(base, block_bytes)
    dealt = base.withColumn("block", block_of(n_blocks)).groupBy("block")
    n_shards = max(1, math.ceil(n_blocks * block_bytes / 6 * ASKED / SHARD_KEYS))
    said = dealt.applyInArrow(_ask_shared(n_shards), "shard int, block int, keys binary, own binary").groupBy("shard").applyInArrow(_tell_shared, "shard int, block int, shared binary")
    rows = checkpointed(dealt.cogroup(said.groupBy("block")).applyInArrow(_open_sets(n_shards), DOCS))
    of_docs = rows.select("doc_id", "n", "a", "b")
    found, salt = of_docs.where("n > 0").groupBy("a", "b", "n").agg(F.min("doc_id").alias("doc_id")), 0
    classes = checkpointed(found.withColumn("id", _class_id(salt)))
    while not classes.groupBy("id").count().where("count > 1").isEmpty():  # two sets of one hash: by another salt
        salt += 1
        classes = checkpointed(classes.withColumn("id", _class_id(salt)))

    sets = checkpointed(rows.where("s is not null").select(_class_id(salt).alias("id"), "s").dropDuplicates(["id"]))
    keys = sets.agg(F.sum(F.size("s"))).first()[0] or 0
    n_blocks, n_shards = max(1, math.ceil(keys * 8 / block_bytes)), max(1, math.ceil(keys / SHARD_KEYS))
    dealt = sets.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")).groupBy("block")
    said = dealt.applyInArrow(_ask_counts(n_shards), "shard int, block int, keys binary, own binary").groupBy("shard").applyInArrow(_tell_counts, "shard int, block int, total binary")
    linked = links(sets, checkpointed(dealt.cogroup(said.groupBy("block")).applyInArrow(_members, MEMBERS)))

    named = classes.withColumn("label", F.col("id")) if linked is None else classes.join(components(linked), "id", "left").withColumn("label", F.coalesce("label", "id"))
    named = checkpointed(named)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")).alias("least")
    heads = checkpointed(named.groupBy("label").agg(least).select("label", "least.doc_id", "least.id"))
    return of_docs, named.select("a", "b", "n", "label"), heads, salt


def near_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: exact components of links at similarity 0.8 on five words.

    Null and empty texts have no shingles and are linked with nothing. Rows of one doc_id are
    documents of their own that share the id. Rows with a null id are linked like others; component_id
    is the least id of the component, and null only if all its rows have none. An empty table gives an
    empty result; other columns are not read."""
    of_docs, classes, heads, _ = _components(docs, block_bytes)
    named = classes.join(heads.select("label", F.col("doc_id").alias("least")), "label").select("a", "b", "n", "least")
    out = of_docs.join(named, ["a", "b", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("n") > 0, F.col("least")), F.col("doc_id")).alias("component_id"))


def _with_digests(batches):
    for batch in batches:
        sets = _sets(batch.column("text"))
        digests = [_digest(s) for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("text"), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array([len(s) for s in sets], pa.int64())], names=["row", "doc_id", "text", "a", "b", "n"])


def without_near_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that represent their component, all columns: one for each. Rows without shingles stay.

    Ids that are null or repeat do not tell which row represents; the sets of those rows are made again."""
    of_docs, _, heads, salt = _components(docs, block_bytes)
    twice = checkpointed(of_docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"))
    kept = heads.select("doc_id").union(of_docs.where("n = 0").select("doc_id")).where("doc_id is not null").distinct()
    n, known = twice.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    if not n:
        return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    single = docs.join(kept.join(twice, "doc_id", "left_anti"), "doc_id", "left_semi").select(*docs.columns)
    unclear = docs.join(twice, "doc_id", "left_semi").select(*docs.columns)
    if known < n:
        unclear = unclear.unionByName(docs.where("doc_id is null"))
    keyed = unclear.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = StructType([*keyed.schema.fields, *(StructField(c, LongType()) for c in "abn")])
    keyed = checkpointed(keyed.mapInArrow(_with_digests, schema).withColumn("id", _class_id(salt)))
    first = F.min_by("row", F.struct("text", F.to_json("row"))).alias("row")
    same = keyed.alias("k").join(heads.alias("h"), (F.col("k.id") == F.col("h.id")) & F.col("k.doc_id").eqNullSafe(F.col("h.doc_id")), "left_semi")
    chosen = keyed.where("n = 0").select("row").union(same.where("n > 0").groupBy("id").agg(first).select("row"))
    return single.unionByName(chosen.select("row.*"))
