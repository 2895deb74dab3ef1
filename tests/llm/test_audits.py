"""Exact copies, source divergence and filter interactions against brute force, with awkward rows and ids."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import groups
from quillgraph.llm.exact_dedup import exact_copies, refined, without_copies
from quillgraph.llm.filter_audit import filter_audit, interactions
from quillgraph.llm.source_divergence import source_divergence, term_counts

from .helpers import WORD, documents, low, nothing, sample

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def awkward(spark):
    """Copies, copies in all but case, copies of a beginning, long texts, null and repeated ids and texts."""
    long = "Wörd and more " * 20_000
    texts = sample(50) + ["x" * 64 + "a", "x" * 64 + "b", "x" * 64 + "a", "Same", "same", "same ", long, long, long + "!", "é", "é"]
    texts += ["twin"] * 4
    ids = list(range(len(texts) - 4)) + [3, 3, None, None]
    ids += [900, 901, 902]
    rows = documents(spark, texts, ids)
    return rows.union(rows.where("doc_id in (5, 900)"))


@pytest.mark.parametrize("most_broadcast", [groups.MOST_BROADCAST, 0])
@pytest.mark.parametrize("hot", [groups.HOT, 2])
def test_exact_copies(spark, monkeypatch, most_broadcast, hot):
    monkeypatch.setattr(groups.with_group, "__defaults__", (most_broadcast,))
    monkeypatch.setattr(groups, "HOT", hot)
    docs = awkward(spark)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    last, size = {}, Counter(t for _, t in rows)
    for i, t in rows:
        last[t] = i if last.get(t) is None else max(last[t], -1 if i is None else i)
    got = exact_copies(docs, F.sha2(F.coalesce("text", F.lit("")), 256).alias("length")).collect()
    text_of = {hashlib.sha256(t.encode()).hexdigest(): t for t in size}
    assert Counter((r.doc_id, text_of[r.length]) for r in got) == Counter(rows)
    assert all((r.keep_id, r.group_size) == (last[text_of[r.length]], size[text_of[r.length]]) for r in got)
    kept = [(r.doc_id, text_of[r.length]) for r in got if r.kept]
    assert sorted(kept, key=str) == sorted(((last[t], t) for t in size), key=str)
    left = without_copies(docs)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text or "") for r in left.collect()), key=str) == sorted(kept, key=str)


def test_only_survivors_are_hashed(spark):
    docs = documents(spark, ["one of a kind", "x" * 64 + "a", "x" * 64 + "b", "copy", "copy", "long " * 9]).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    assert {r.text for r in refined(docs).where("full is not null").collect()} == {"x" * 64 + "a", "x" * 64 + "b", "copy", ""}


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for result in (exact_copies(nothing(spark)), without_copies(nothing(spark)), source_divergence(nothing(spark)), filter_audit(nothing(spark), labels)):
        assert result.count() == 0


def divergence(rows, least_docs, top):
    docs = [(lang or "", source or "", TERM.findall(low(text or ""))) for text, lang, source in rows]
    out = []
    for lang in {x[0] for x in docs}:
        own = [x for x in docs if x[0] == lang]
        held = Counter(t for x in own for t in set(x[2]))
        vocabulary = [t for t in held if held[t] >= least_docs]
        counts = {s: Counter() for s in {x[1] for x in own}}
        for _, s, terms in own:
            counts[s].update(t for t in terms if held[t] >= least_docs)
        whole = sum(counts.values(), Counter())

        def p(count):
            n = sum(count.values()) + len(vocabulary)
            return {t: 1 + 10**9 * (count[t] + 1) // n for t in vocabulary}

        ps, q = {s: p(c) for s, c in counts.items()}, p(whole)
        for s in counts:
            pair = [(sum((ps[s][t] - ps[o][t]) ** 2 // ps[o][t] for t in vocabulary), o) for o in counts if o != s]
            term = [((ps[s][t] - q[t]) ** 2 // q[t], t) for t in vocabulary if counts[s][t] and ps[s][t] > q[t]]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize("most_groups", [1 << 16, 0])
def test_source_divergence(spark, monkeypatch, most_groups):
    import quillgraph.llm.source_divergence as module

    monkeypatch.setattr(module, "MOST_GROUPS", most_groups)
    rnd = random.Random(4)
    words = [*("Ab", "aB", "don't", "x9y", "Éa", "éa", "日本", "á", "z z", "😀k"), *(f"w{chr(97 + k)}" for k in range(12))]
    rows = [(" ".join(rnd.choices(words, k=rnd.randint(0, 30))), rnd.choice(["en", "de", None, ""]), rnd.choice(["s1", "s2", "s3", None, ""])) for _ in range(80)]
    rows += [(None, "en", "silent"), ("", "only", "one"), ("rare", "two", "a"), ("words", "two", "b"), ("Ab " * 50_000, "en", "s1")] + rows[:5]
    docs = spark.createDataFrame([(k % 9 or None, *r, 0, "clash", "clash") for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n int, term string, p string")
    got = sorted(tuple(r) for r in source_divergence(docs, 3, 5).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == divergence(rows, 3, 5)
    counted = {(r.lang, r.source, r.term): (r.n, r.docs) for r in term_counts(docs).collect()}
    assert counted["two", "a", "rare"] == (1, 1) and sum(n for n, _ in counted.values()) == sum(len(TERM.findall(r[0] or "")) for r in rows)


def test_shares_of_many_words_are_exact(spark):
    from quillgraph.llm.source_divergence import excess, share

    cases = [(9 * 10**12, 9 * 10**12, 5), (0, 9 * 10**14, 10**9), (7 * 10**14, 9 * 10**14, 3), (0, 0, 1), (123_456_789_012, 999_999_999_999, 77)]
    table = spark.createDataFrame(cases, "n long, total long, v long")
    got = table.select(share(F.col("n"), F.col("total"), F.col("v")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (n + 1) // (total + v) for n, total, v in cases]
    pairs = [(10**9 + 1, 1), (1, 10**9 + 1), (77, 77), (5, 3)]
    got = spark.createDataFrame(pairs, "p long, q long").select(excess(F.col("p"), F.col("q")).alias("f")).collect()
    assert [r.f for r in got] == [(p - q) ** 2 // q for p, q in pairs]


def audited(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    fails = []
    for i, t, part in rows:
        t = t or ""
        w = WORD.findall(t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        own = [x for x in labels if x[0] == i and i is not None]
        fails.append((part or "", {k for k in bad if bad[k]}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, shapley = [], Counter()
    for part in {x[0] for x in fails}:
        for order in permutations("ABCDE"):
            left = [x for x in fails if x[0] == part]
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                every = [x for x in fails if x[0] == part and f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[part, f] += len(gone)
                out.append((part, "".join(order), k + 1, len(left), len(gone), len(every) - len(gone), sum(x[1] == {f} for x in every), sum(x[2] for x in gone), sum(x[3] for x in gone), f))
    return sorted((*x[:-1], shapley[x[0], x[-1]]) for x in out)


def test_filter_audit(spark):
    rnd = random.Random(7)
    words = ["alpha", "Beta", "C", "delta", "é", "x#", "100%", "DDD"] + [f"w{k}" for k in range(400)]
    rows = []
    for k in range(90):
        few = rnd.sample(words, rnd.choice([3, 40, 300]))
        rows.append((k, " ".join(rnd.choices(few, k=rnd.choice([0, 20, 199, 200, 320]))), rnd.choice(["en", "de", None, ""])))
    rows += [(None, rows[3][1], "en"), (None, "none", "fr"), (4, rows[4][1], "en"), (4, rows[4][1], "en"), (500, "big W " * 60_000, "en"), (501, None, "void"), (502, "", "void")]
    rows += [(600 + k, rows[rnd.randrange(90)][1], "en") for k in range(40)]
    labels = [(k, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for k in range(0, 95, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (99_999, 1, 1)]
    docs = spark.createDataFrame([(*r, True, "clash", "clash", 1) for r in rows], "doc_id long, text string, lang string, a boolean, digest string, quality string, n int")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit(docs, table)
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got.columns == columns
    assert sorted(tuple(r) for r in got.collect()) == audited(rows, labels)


def test_interactions_of_other_filters(spark):
    """Two filters, a null condition, no marks; the counts of a step add up to those of the step before."""
    rows = spark.createDataFrame([(1, 1, "p"), (1, None, "p"), (None, 1, "p"), (0, 0, None)], "x int, y int, z string")
    got = interactions(rows, {"X": F.col("x") == 1, "Y": F.col("y") == 1}, F.col("z")).orderBy("part", "filter_order", "step").collect()
    assert [(r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in got] == [
        ("", "XY", 1, 1, 0, 0, 0, 0), ("", "XY", 2, 1, 0, 0, 0, 0), ("", "YX", 1, 1, 0, 0, 0, 0), ("", "YX", 2, 1, 0, 0, 0, 0),
        ("p", "XY", 1, 1, 2, 0, 1, 3), ("p", "XY", 2, 0, 1, 1, 1, 3), ("p", "YX", 1, 1, 2, 0, 1, 3), ("p", "YX", 2, 0, 1, 1, 1, 3),
    ]
    with pytest.raises(ValueError):
        interactions(rows, {k: F.lit(True) for k in "ABCDEFGH"}, F.col("z"))
