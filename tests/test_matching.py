"""Greedy matching in components and rounds, and containment by automata, against brute force."""

import math
import os
import random

import pytest

from quillgraph.operators import align
from quillgraph.operators.compare import content_recall

DIR = "/root/testdata/sf0.001"


def brute(rows, last_first=False):
    taken, used = set(), set()
    best = {}
    for b, x, y, s in rows:
        best[b, x, y] = max(s, best.get((b, x, y), s))
    order = sorted(best.items(), key=lambda r: (r[0][2], r[0][1]), reverse=last_first)
    for (b, x, y), s in sorted(order, key=lambda r: -r[1]):
        if (b, "l", x) not in used and (b, "r", y) not in used:
            used |= {(b, "l", x), (b, "r", y)}
            taken.add((b, x, y, s))
    return taken


@pytest.mark.parametrize("together", [1 << 16, 3])
@pytest.mark.parametrize("last_first", [False, True])
def test_greedy_equals_one_by_one(spark, together, last_first):
    rnd = random.Random(6)
    rows = [(f"b{rnd.randrange(3)}", f"x{rnd.randrange(14)}", f"y{rnd.randrange(14)}", rnd.choice([0.2, 0.5, 0.5, 0.9])) for _ in range(90)]
    table = spark.createDataFrame(rows, "pair_id string, ref string, cand string, score double")
    got = [tuple(r) for r in align.greedy(table, last_first=last_first, together=together).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, last_first)
    assert align.greedy(table.limit(0)).count() == 0


def test_a_chain_of_ties_is_settled_at_once(spark, monkeypatch):
    """Six hundred pairs, each of which waits for the one before: one round and no more tables than for a short one."""
    n = 300
    rows = [r for k in range(n) for r in ((1, f"x{k:05}", f"y{k:05}", 0.5), (1, f"x{k + 1:05}", f"y{k:05}", 0.5))]
    table = spark.createDataFrame(rows, "pair_id long, ref string, cand string, score double")
    made = []
    real = align.checkpointed
    monkeypatch.setattr(align, "checkpointed", lambda df: made.append(1) or real(df))
    got = {tuple(r) for r in align.greedy(table).collect()}
    assert got == brute(rows) and len(made) < 30


@pytest.mark.parametrize("block_bytes", [1 << 22, 40])
def test_contained_texts_are_found(spark, block_bytes):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abÉ") for _ in range(rnd.randint(1, 3)))
    texts = [" ".join(word() for _ in range(rnd.randint(0, 12))) for _ in range(40)] + [None, "", "  Spaced\tOUT  text "]
    wanted = [(k, " ".join(word() for _ in range(rnd.randint(1, 4)))) for k in range(60)] + [(100, texts[3]), (101, "ced out TE"), (102, None), (103, " "), (104, "x"), (104, "spaced"), (105, "b")]
    fold = lambda t: " ".join(t.split()).lower()
    folded = [fold(t) for t in texts if t is not None]
    want = {}
    for k, t in wanted:
        want[k] = want.get(k, False) or bool(t and fold(t) and any(fold(t) in x for x in folded))
    got = content_recall(spark.createDataFrame(wanted, "id long, text string"), spark.createDataFrame([(t,) for t in texts], "text string"), block_bytes=block_bytes)
    assert {r.id: r.found for r in got.collect()} == want and any(want.values()) and not all(want.values())
    none = spark.createDataFrame([], "id long, text string")
    assert content_recall(none, none).count() == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
def test_greedy_align_takes_what_brute_force_takes(spark, monkeypatch):
    """The query over whole tables: its scored pairs against features made in Python, its matching against one by one."""
    from quillgraph.plans import suite

    seen, real = [], align.greedy
    monkeypatch.setattr(suite.align, "greedy", lambda scored: seen.append(scored) or real(scored))
    got = {(r.ref, r.cand, round(r.score, 9)) for r in suite.greedy_align(spark, DIR).collect()}

    def features(name, key, nation, balance):
        rows = spark.read.parquet(f"{DIR}/{name}.parquet").where(f"{key} is not null").collect()
        return {f"{name}/{r[key]}": {f"n{r[nation]}", f"b{math.floor(r[balance] / 500)}", f"k{r[key] % 97}"} for r in rows if r[nation] is not None and r[balance] is not None}

    left, right = features("supplier", "s_suppkey", "s_nationkey", "s_acctbal"), features("customer", "c_custkey", "c_nationkey", "c_acctbal")
    nation = lambda f: next(x for x in f if x[0] == "n")
    want = {(a, b): len(x & y) / len(x | y) for a, x in left.items() for b, y in right.items() if nation(x) == nation(y)}
    scored = {(r.ref, r.cand): r.score for r in seen[0].collect()}
    assert {k: scored[k] for k in want} == pytest.approx(want)
    taken = brute([(1, a, b, s) for (a, b), s in scored.items()])
    assert got == {(a, b, round(s, 9)) for _, a, b, s in taken} and len(got) > 5


def test_groups_of_equal_features_take_what_their_pairs_take(spark, monkeypatch):
    """Many individuals with few features: no pair is written out, however many there are, nor in several classes a node."""
    rnd = random.Random(3)
    features, classes = [], []
    for side, n in (("a", 40), ("b", 70)):
        for k in range(n):
            kinds = rnd.sample(["p", "q", "r", "lone" + side], rnd.choice([1, 1, 2]))
            classes += [(side, f"{side}{k}", c) for c in kinds]
            features += [(side, f"{side}{k}", f) for f in rnd.sample(range(9), rnd.randint(1, 4))] + [(side, f"{side}{k}", None)] * (k % 5 == 0)
    features, classes = spark.createDataFrame(features, "graph_id string, s string, feature long"), spark.createDataFrame(classes, "graph_id string, s string, class string")
    pairs = spark.createDataFrame([(7, "a", "b"), (8, "b", "a")], "pair_id long, ref_id string, cand_id string")
    want = brute([tuple(r) for r in align.jaccard_pairs(features, pairs, classes).collect()])
    for kinds, members in ((classes, 1 << 20), (classes.where("class = 'p'"), 1 << 20), (classes, 3)):
        wanted = want if kinds is classes else brute([tuple(r) for r in align.jaccard_pairs(features, pairs, kinds).collect()])
        with monkeypatch.context() as m:
            m.setattr(align, "MOST_TOGETHER", 10)
            m.setattr(align, "MOST_MEMBERS", members)
            if members > 3:
                m.setattr(align, "jaccard_pairs", None)
            got = [tuple(r) for r in align.jaccard_aligned(features, pairs, kinds).collect()]
        assert len(got) == len(set(got)) and set(got) == wanted and len(got) > 10


@pytest.mark.parametrize("together", [1 << 16, 5])
def test_equal_labels_are_compared_once(spark, monkeypatch, together):
    """Two thousand individuals of six labels: 36 label pairs a class are scored, not a million pairs."""
    names = ["red ring", "old ring", "red bolt", "old plate", "small ring", "red rings"]
    n = 1000 if together > 5 else 40
    rows = [(g, f"c{k % 2}", f"{g}{k:04}", names[(k * (3 if g == "a" else 5)) // 7 % 6] + ("" if g == "a" else " land")) for g in "ab" for k in range(n)]
    scored, real = [], align.fuzzy_scores
    monkeypatch.setattr(align, "fuzzy_scores", lambda c, t: scored.append(c.count()) or real(c, t))
    monkeypatch.setattr(align, "MOST_TOGETHER", together)
    pairs = spark.createDataFrame([("x", "a", "b")], "pair_id string, ref_id string, cand_id string")
    got = [tuple(r) for r in align.fuzzy_aligned(spark.createDataFrame(rows, "graph_id string, class string, s string, label string"), pairs).collect()]
    sides = [[r for r in rows if r[0] == g] for g in "ab"]
    best = [(f"x\x1f{c}", s, t, round(align.similarity(x, y), 3)) for _, c, s, x in sides[0] for _, d, t, y in sides[1] if c == d and align.similarity(x, y) >= 0.55]
    assert scored == [72] and set(got) == brute(best, last_first=True) and len(got) == len(set(got))
