"""One-to-one alignment of two graphs' individuals: block, score, match greedily.

Under a total order by (score descending, then the two names), taking every pair that is first on both
its sides, round by round, gives the same pairs as taking them one by one; and what one component of
pairs takes does not depend on another. So small components are settled each in one task, and only
components too large for that go by rounds.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache, reduce
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import terms as T
from .closure import checkpointed


#: Pairs of one block or component that a task takes one by one; larger components go by rounds until they fall apart.
MOST_TOGETHER = 1 << 16
#: Individuals of one component of classes that a task settles from their features.
MOST_MEMBERS = 1 << 20


def greedy(scored: DataFrame, block: str = "pair_id", left: str = "ref", right: str = "cand", last_first: bool = False, together: int = MOST_TOGETHER) -> DataFrame:
    """Rows of (block, left, right, score) that a greedy one-to-one matching takes.

    Ties go to the smallest (right, left), or the largest if last_first. A block of at most
    `together` pairs is settled in one task, pair by pair in order, however long its chains of ties are. In a
    larger one, pairs that share an end form components, which do not touch each other and are settled in the
    same way; in components that are too large for it, rounds take all pairs that are first on
    both their sides, and what is left is parted again. Repeated pairs count once, with their best score."""
    way = (lambda c: F.col(c).desc()) if last_first else (lambda c: F.col(c).asc())
    order = [F.col("score").desc(), way(right), way(left)]
    rank = lambda c: F.row_number().over(Window.partitionBy(block, c).orderBy(*order))
    pairs = checkpointed(scored.groupBy(block, left, right).agg(F.max("score").alias("score")))
    shape, settled = pairs.schema, _in_order(block, left, right, last_first)
    sizes = pairs.groupBy(block).agg(F.count(F.lit(1)).alias("_n"))
    pairs = checkpointed(pairs.join(sizes, block))
    taken = [pairs.where(F.col("_n") <= together).drop("_n").withColumn("_part", F.xxhash64(block)).groupBy("_part").applyInPandas(settled, shape)]
    left_over = pairs.where(F.col("_n") > together).drop("_n")
    while not left_over.isEmpty():
        parted = checkpointed(_parted(left_over, block, left, right))
        small = parted.where(F.col("_n") <= together).drop("_n")
        taken.append(checkpointed(small.groupBy("_part").applyInPandas(settled, shape)))
        left_over = parted.where(F.col("_n") > together).drop("_n", "_part")
        first = checkpointed(left_over.withColumn("_l", rank(left)).withColumn("_r", rank(right)).where("_l = 1 and _r = 1").drop("_l", "_r"))
        taken.append(first)
        left_over = checkpointed(left_over.join(first.select(block, left), [block, left], "left_anti").join(first.select(block, right), [block, right], "left_anti"))
    return reduce(DataFrame.unionByName, taken).select(*[c for c in scored.columns if c in (block, left, right, "score")])


def _parted(pairs: DataFrame, block: str, left: str, right: str) -> DataFrame:
    """pairs with `_part`, one value a component, and `_n`, its number of pairs.

    Contraction: each end points to the least of its neighbours, pointers are followed to their roots, and
    edges go on between roots; each round leaves at most half of the ends, however long the chains are."""
    ends = lambda c, tag: F.xxhash64(block, F.lit(tag), c)
    keyed = checkpointed(pairs.withColumn("_l", ends(left, "l")).withColumn("_r", ends(right, "r")))
    edges = keyed.select(F.col("_l").alias("a"), F.col("_r").alias("b")).distinct()
    labels = checkpointed(keyed.select(F.col("_l").alias("id")).union(keyed.select("_r")).distinct().withColumn("label", F.col("id")))
    while True:
        roots = _roots(checkpointed(edges.union(edges.select("b", "a")).groupBy(F.col("a").alias("id")).agg(F.min("b").alias("to")).withColumn("to", F.least("id", "to"))))
        of = lambda name: roots.toDF(name, f"root_{name}")  # noqa: E731,B023
        labels = checkpointed(labels.join(of("label"), "label", "left").select("id", F.coalesce("root_label", "label").alias("label")))
        edges = checkpointed(edges.join(of("a"), "a").join(of("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).where("a <> b").distinct())
        if edges.isEmpty():
            break
    met = keyed.join(labels.select(F.col("id").alias("_l"), F.col("label").alias("_part")), "_l").drop("_l", "_r")
    return met.join(met.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")), "_part")


def _roots(pointers: DataFrame) -> DataFrame:
    """id, to: pointers (id, to), which lead downwards, followed to their ends by doubling."""
    while True:
        further = pointers.toDF("to", "_to")
        longer = checkpointed(pointers.join(further, "to", "left").select("id", F.col("to").alias("_old"), F.coalesce("_to", "to").alias("to")))
        pointers = longer.select("id", "to")
        if longer.where("_old <> to").isEmpty():
            return pointers


def _in_order(block: str, left: str, right: str, last_first: bool):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.drop(columns="_part").sort_values(["score", right, left], ascending=[False, not last_first, not last_first], kind="stable")
        used: tuple[set, set] = (set(), set())
        rows = []
        # hashes of ends may fall together, so a part may hold several blocks
        for row, b, x, y in zip(f.index, f[block], f[left], f[right], strict=True):
            if (b, x) not in used[0] and (b, y) not in used[1]:
                used[0].add((b, x))
                used[1].add((b, y))
                rows.append(row)
        return f.loc[rows]

    return run


def _by_groups(lefts: list[list], rights: list[list], row: Callable[[int], np.ndarray], last_first: bool) -> Iterator[tuple]:
    """(left, right, score) that a greedy matching takes, of members whose groups alone decide their scores.

    row(c): the scores of right group c with all left groups, 0 where they make no pair. Each right group waits in
    a heap with its best score so far; scores only fall while members go, so one that still holds is the next pair's.
    Rows are made when asked for: no pair of members is, and no more than one row is held."""
    order = lambda groups: {x: k for k, x in enumerate(sorted((x for g in groups for x in g), reverse=last_first))}
    places = tuple(order(groups) for groups in (lefts, rights))
    waiting = tuple([sorted(g, key=place.__getitem__, reverse=True) for g in groups] for groups, place in zip((lefts, rights), places, strict=True))
    gone = len(places[0])
    if not gone:
        return
    head = np.array([places[0][g[-1]] for g in waiting[0]], dtype=np.int64)

    def best(c: int) -> tuple[float, int]:
        scores = np.where(head < gone, row(c), 0.0)
        most = scores.max(initial=0.0)
        return most, int(np.argmin(np.where(scores == most, head, gone)))

    heap = [(-score, places[1][waiting[1][c][-1]], c) for c in range(len(rights)) for score, _ in [best(c)] if score > 0]
    heapq.heapify(heap)
    while heap:
        held, place, c = heap[0]
        score, g = best(c)
        if score <= 0:
            heapq.heappop(heap)
        elif score != -held:
            heapq.heapreplace(heap, (-score, place, c))
        else:
            yield waiting[0][g].pop(), waiting[1][c].pop(), score
            head[g] = places[0][waiting[0][g][-1]] if waiting[0][g] else gone
            if waiting[1][c]:
                heapq.heapreplace(heap, (held, places[1][waiting[1][c][-1]], c))
            else:
                heapq.heappop(heap)


def individual_features(triples: DataFrame, vocabulary: tuple[str, ...]) -> DataFrame:
    """graph_id, s, feature: literals by predicate, objects by their classes (or name), and own classes.

    A type counts twice, as a predicate like others and as the class itself."""
    s, p, o = F.col("s"), F.col("p"), F.col("o")
    body = triples.where(~T.is_schema(p, o))
    types = body.where(p == T.TYPE).where(~o.isin(*T.SCHEMA_TYPES)).select("graph_id", F.col("s").alias("node"), T.local_name(o).alias("class")).distinct()
    who = types.select("graph_id", F.col("node").alias("s")).distinct().where(T.is_iri(s) & ~T.in_namespaces(s, vocabulary))
    own = body.join(who, ["graph_id", "s"], "left_semi")
    texts = own.where(T.is_literal(o)).select("graph_id", "s", F.concat_ws("\x1f", T.local_name(p), T.folded(T.lexical(o))).alias("feature"))
    linked = own.where(T.is_iri(o)).join(types.withColumnRenamed("node", "o"), ["graph_id", "o"], "left")
    links = linked.select("graph_id", "s", F.concat_ws("\x1f", T.local_name(p), F.concat(F.lit("@"), F.coalesce("class", T.local_name(o)))).alias("feature"))
    classes = types.withColumnRenamed("node", "s").join(who, ["graph_id", "s"], "left_semi").select("graph_id", "s", F.concat_ws("\x1f", F.lit("rdf:type"), F.concat(F.lit("@"), F.col("class"))).alias("feature"))
    return texts.unionByName(links).unionByName(classes).distinct()


def jaccard_pairs(features: DataFrame, pairs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """pair_id, ref, cand, score of individuals that share a feature (and a class, if classes are given).

    An inverted index: sides meet on the feature; sizes of both sets make the union."""
    sizes = features.groupBy("graph_id", "s").agg(F.count(F.lit(1)).alias("n"))
    side = lambda who, name: pairs.select("pair_id", F.col(who).alias("graph_id")).join(features, "graph_id").join(sizes, ["graph_id", "s"]).select("pair_id", "feature", F.col("s").alias(name), F.col("n").alias(f"n_{name}"))
    met = side("ref_id", "ref").join(side("cand_id", "cand"), ["pair_id", "feature"]).groupBy("pair_id", "ref", "cand", "n_ref", "n_cand").agg(F.count(F.lit(1)).alias("both"))
    if classes is not None:
        kind = lambda who, name: pairs.select("pair_id", F.col(who).alias("graph_id")).join(classes, "graph_id").select("pair_id", "class", F.col("s").alias(name))
        shared = kind("ref_id", "ref").join(kind("cand_id", "cand"), ["pair_id", "class"]).select("pair_id", "ref", "cand").distinct()
        met = met.join(shared, ["pair_id", "ref", "cand"], "left_semi")
    return met.select("pair_id", "ref", "cand", (F.col("both") / (F.col("n_ref") + F.col("n_cand") - F.col("both"))).alias("score"))


def jaccard_aligned(features: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """greedy(jaccard_pairs(features, pairs, classes)), whose pairs are written out only where they are few.

    Individuals of the same features and classes are one group. Groups that classes join are settled in one task,
    which reads scores off an inverted index of its features, so rows grow with the individuals and not with their
    pairs; individuals of components of more than MOST_MEMBERS go by their pairs."""
    of = lambda who, table: pairs.select("pair_id", F.col(who).alias("graph_id")).join(table, "graph_id").drop("graph_id")
    counts = [of(who, classes).groupBy("pair_id", "class").agg(F.count(F.lit(1)).cast("double").alias(who)) for who in ("ref_id", "cand_id")]
    if (counts[0].join(counts[1], ["pair_id", "class"]).agg(F.sum(F.col("ref_id") * F.col("cand_id"))).first()[0] or 0) <= MOST_TOGETHER:
        return greedy(jaccard_pairs(features, pairs, classes))
    told = features.groupBy("graph_id", "s").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("feature")).alias("features"))
    told = checkpointed(told.join(classes.groupBy("graph_id", "s").agg(F.sort_array(F.collect_set("class")).alias("classes")), ["graph_id", "s"]))
    members = of("ref_id", told).withColumn("side", F.lit("ref")).unionByName(of("cand_id", told).withColumn("side", F.lit("cand")))
    whole = F.concat_ws("\x1f", "classes")
    if told.where(F.size("classes") > 1).isEmpty():
        members = members.withColumn("_part", F.xxhash64(whole))
    else:
        links = members.select("pair_id", whole.alias("whole"), F.explode("classes").alias("class")).distinct()
        parts = _parted(links, "pair_id", "whole", "class").select("pair_id", "whole", "_part").distinct()
        members = members.withColumn("whole", whole).join(parts, ["pair_id", "whole"]).drop("whole")
    sizes = checkpointed(members.groupBy("pair_id", "_part").agg(F.count(F.lit(1)).alias("_n")))
    few, many = (sizes.where(c).drop("_n") for c in (F.col("_n") <= MOST_MEMBERS, F.col("_n") > MOST_MEMBERS))
    groups = members.join(few, ["pair_id", "_part"], "left_semi").groupBy("pair_id", "_part", "side", "classes", "features", "n").agg(F.collect_list("s").alias("names"))
    kind = dict(members.dtypes)["pair_id"]
    tasks = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # parts are few and long: none waits for another
    taken = groups.repartition(tasks, "pair_id", "_part").groupBy("pair_id", "_part").applyInPandas(_jaccard_settled, f"pair_id {kind}, ref string, cand string, score double")
    if many.isEmpty():
        return taken
    wide = members.join(many, ["pair_id", "_part"], "left_semi").select("pair_id", "s", "side")
    ends = [wide.where(F.col("side") == side).select("pair_id", F.col("s").alias(side)) for side in ("ref", "cand")]
    rest = jaccard_pairs(features, pairs, classes)
    for end in ends:
        rest = rest.join(end, end.columns, "left_semi")
    return taken.unionByName(greedy(rest))


def _jaccard_settled(f: pd.DataFrame) -> pd.DataFrame:
    left, right = (f[f.side == side] for side in ("ref", "cand"))
    sizes, columns = left.n.to_numpy(), {}
    for c in ("features", "classes"):
        found = defaultdict(list)
        for k, xs in enumerate(left[c]):
            for x in xs:
                found[x].append(k)
        columns[c] = {x: np.array(ks) for x, ks in found.items()}
    none = np.zeros(0, dtype=np.int64)
    asked = list(zip(right.features, right.classes, right.n, strict=True))

    def row(c: int) -> np.ndarray:
        features, classes, n = asked[c]
        both = np.bincount(np.concatenate([none, *[columns["features"].get(x, none) for x in features]]), minlength=len(sizes))
        met = np.zeros(len(sizes), dtype=bool)
        met[np.concatenate([none, *[columns["classes"].get(x, none) for x in classes]])] = True
        return np.where(met, both / np.maximum(sizes + n - both, 1), 0.0)

    rows = _by_groups(left.names.tolist(), right.names.tolist(), row, False)
    return pd.DataFrame(rows, columns=["ref", "cand", "score"]).assign(pair_id=f.pair_id.iloc[0])[["pair_id", "ref", "cand", "score"]]


def aligned(triples: DataFrame, pairs: DataFrame, vocabulary: tuple[str, ...]) -> DataFrame:
    """pair_id, ref, cand, score: the class-aware alignment of individuals."""
    features = checkpointed(individual_features(triples, vocabulary))
    classes = triples.where((F.col("p") == T.TYPE) & ~F.col("o").isin(*T.SCHEMA_TYPES)).select("graph_id", "s", F.col("o").alias("class")).distinct()
    return jaccard_aligned(features, pairs, classes)


def rewritten(triples: DataFrame, alignment: DataFrame, pairs: DataFrame) -> DataFrame:
    """Candidate triples of each pair with aligned IRIs replaced by the reference's; graph_id is the pair's."""
    rows = pairs.select("pair_id", F.col("cand_id").alias("graph_id")).join(triples, "graph_id")
    for c in ("s", "o"):
        names = alignment.select("pair_id", F.col("cand").alias(c), F.col("ref").alias("_new"))
        rows = rows.join(names, ["pair_id", c], "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return rows.select(F.col("pair_id").cast("string").alias("graph_id"), "s", "p", "o").distinct()


def aligned_scores(triples: DataFrame, pairs: DataFrame, vocabulary: tuple[str, ...]) -> DataFrame:
    """pair_id, precision, recall, f1 of triples after alignment, and how many individuals were aligned."""
    from .compare import set_scores, shown_triples

    found = aligned(triples, pairs, vocabulary)
    cand = shown_triples(rewritten(triples, found, pairs), vocabulary).withColumn("graph_id", F.concat(F.lit("cand:"), "graph_id"))
    ref = shown_triples(pairs.select("pair_id", F.col("ref_id").alias("graph_id")).join(triples, "graph_id").select(F.col("pair_id").cast("string").alias("graph_id"), "s", "p", "o"), vocabulary).withColumn("graph_id", F.concat(F.lit("ref:"), "graph_id"))
    named = pairs.select("pair_id", F.concat(F.lit("ref:"), F.col("pair_id").cast("string")).alias("ref_id"), F.concat(F.lit("cand:"), F.col("pair_id").cast("string")).alias("cand_id"))
    scores = set_scores(ref.unionByName(cand), named, ["s", "p", "o"])
    return scores.join(found.groupBy("pair_id").agg(F.count(F.lit(1)).alias("aligned")), "pair_id", "left").fillna(0, ["aligned"])


@lru_cache(maxsize=1 << 16)
def similarity(a: str, b: str) -> float:
    """0 if either is empty, 1 if equal, else the better of matching-block ratio and word Jaccard."""
    a, b = (" ".join(x.lower().replace("_", " ").split()) for x in (a, b))
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    x, y = set(a.split()), set(b.split())
    words = len(x & y) / len(x | y)
    most = SequenceMatcher(None, a, b)
    return max(most.ratio(), words) if most.real_quick_ratio() > words else words


def fuzzy_scores(candidates: DataFrame, threshold: float = 0.55) -> DataFrame:
    """block, ref, cand, score of candidate pairs (block, ref, cand, ref_labels, cand_labels) at the threshold.

    A pair's score is the best of any two of its labels, to three places."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            scores = [max((similarity(x, y) for x in a for y in b), default=0.0) for a, b in zip(f.ref_labels, f.cand_labels, strict=True)]
            out = f[["block", "ref", "cand"]].assign(score=[round(s, 3) for s in scores], exact=scores)
            yield out[out.exact >= threshold].drop(columns="exact")

    return candidates.select(F.col("block").cast("string").alias("block"), "ref", "cand", "ref_labels", "cand_labels").mapInPandas(run, "block string, ref string, cand string, score double")


def fuzzy_aligned(labels: DataFrame, pairs: DataFrame, threshold: float = 0.55) -> DataFrame:
    """block, ref, cand, score: greedy fuzzy matching within a pair's classes.

    labels: graph_id, class, s, label. Ties go to the largest names. A class on one side alone gives
    nothing."""
    sets = labels.groupBy("graph_id", "class", "s").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    groups = checkpointed(sets.groupBy("graph_id", "class", "labels").agg(F.min("s").alias("group"), F.collect_list("s").alias("names")))
    side = lambda who, name: pairs.select("pair_id", F.col(who).alias("graph_id")).join(groups, "graph_id").select(F.concat_ws("\x1f", "pair_id", "class").alias("block"), F.col("group").alias(name), F.col("labels").alias(f"{name}_labels"), "names")
    ref, cand = side("ref_id", "ref"), side("cand_id", "cand")
    scored = checkpointed(fuzzy_scores(ref.drop("names").join(cand.drop("names"), "block"), threshold))
    sizes = checkpointed(scored.groupBy("block").agg(F.count(F.lit(1)).alias("_n")))
    few, many = (sizes.where(c).select("block") for c in (F.col("_n") <= MOST_TOGETHER, F.col("_n") > MOST_TOGETHER))
    names = lambda table, name: table.select("block", name, "names")
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [scored, names(ref, "ref"), names(cand, "cand")]).join(few, "block", "left_semi")
    taken = rows.repartition("block").sortWithinPartitions("block").mapInPandas(_fuzzy_settled, "block string, ref string, cand string, score double")
    if many.isEmpty():
        return taken
    rest = scored.join(many, "block", "left_semi")
    for table, name in ((ref, "ref"), (cand, "cand")):
        rest = rest.join(names(table, name), ["block", name]).withColumn(name, F.explode("names")).drop("names")
    return taken.unionByName(greedy(rest.select("block", "ref", "cand", "score"), block="block", last_first=True))


def _fuzzy_settled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows that blocks order: scored pairs of groups, and groups of either side with their names."""
    made = lambda rows: pd.DataFrame(rows, columns=["block", "ref", "cand", "score"]).astype({"score": "float64"})
    told, out = (r for f in frames for r in zip(f.block, f.ref, f.cand, f.score, f.names, strict=True)), []
    for block, own in groupby(told, key=itemgetter(0)):
        left, right, lefts, rights, found = {}, {}, [], [], []
        for _, x, y, score, names in own:
            if x is not None and y is not None:
                found.append((x, y, score))
            else:
                side, members = (left, lefts) if y is None else (right, rights)
                side[x if y is None else y] = len(members)
                members.append(names)
        at = defaultdict(lambda: ([], []))
        for x, y, score in found:
            at[right[y]][0].append(left[x])
            at[right[y]][1].append(score)

        def row(c: int, at=at, n=len(lefts)) -> np.ndarray:
            scores = np.zeros(n)
            if c in at:
                scores[at[c][0]] = at[c][1]
            return scores

        out += [(block, *r) for r in _by_groups(lefts, rights, row, True)]
        if len(out) >= 1 << 14:
            yield made(out)
            out = []
    yield made(out)


def class_means(matched: DataFrame) -> DataFrame:
    """block, matched, mean score to three places."""
    return matched.groupBy("block").agg(F.count(F.lit(1)).alias("matched"), F.round(F.avg("score"), 3).alias("mean_score"))
