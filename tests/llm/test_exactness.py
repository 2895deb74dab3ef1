"""Cases that exact operators once got wrong: regions merged with unlike rooms, rows that share an id."""

import random

import pytest
from pyspark.sql import functions as F

from .helpers import WORD, components, documents


def families(n):
    """Pairs of a text and the same text with two more words, whose tails are frequent elsewhere."""
    rnd, texts = random.Random(2), []
    for k in range(n):
        x = [f"f{k}_{j}" for j in range(13)]
        y = [*x, rnd.choice("pqr"), rnd.choice("pqr")]
        texts += [" ".join(x), " ".join(y)]
    tails = [t.split()[-6:] for t in texts[1::2]]
    return texts + [" ".join([f"g{k}", *rnd.choice(tails)]) for k in range(n // 2)]


def test_every_link_of_small_families_is_found(spark):
    from quillgraph.llm.jaccard_join import near_duplicates

    docs = documents(spark, families(600))
    got = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert [k for k in range(600) if got[2 * k + 1] != 2 * k] == []


@pytest.mark.parametrize("seed", range(3))
def test_random_small_sets_equal_brute_force(spark, seed):
    """All sizes from 5 to 40 words, few edits, tails that many share, at the real sizes of leaves."""
    from quillgraph.llm.jaccard_join import near_duplicates

    rnd, texts = random.Random(seed), []
    tails = [[f"t{k}{j}" for j in range(6)] for k in range(3)]
    for k in range(70):
        base = [f"b{seed}_{k}_{j}" for j in range(rnd.randint(5, 40))] + (rnd.choice(tails) if rnd.random() < 0.6 else [])
        for _ in range(rnd.randint(1, 4)):
            w = list(base)
            for _ in range(rnd.randint(0, 2)):
                cut = rnd.random()
                if cut < 0.4:
                    w = w[: -rnd.randint(1, 3)] or w
                elif cut < 0.8:
                    w = [*w, *rnd.choice(tails)[: rnd.randint(1, 3)]]
                else:
                    w[rnd.randrange(len(w))] = "edit"
            texts.append(" ".join(w))
    docs = documents(spark, texts)
    want = components({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, 20_000).collect()} == want


def test_rows_of_one_id_lose_repeats_in_any_blocks(spark):
    from quillgraph.llm.substrings import without_repeats

    rnd = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(30))
    texts = [f"{' '.join(f'u{k}_{j}' for j in range(rnd.randint(1, 40)))} {passage} {k}" for k in range(24)] + [passage, passage, " ".join(["same"] * 50)]
    ids = [1] * 8 + [None] * 8 + list(range(2, 10)) + [1, None, None]
    docs = documents(spark, texts, [*ids, None, 30, 31])
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1))
    rows = [(r.doc_id, r.text) for r in ordered.orderBy(F.col("doc_id").asc_nulls_last(), "key", "text").collect()]
    seen, want = set(), []
    for i, text in rows:
        w = WORD.findall(text)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(x)
        want.append((i, len(w), sum(gone), " ".join(a for a, g in zip(w, gone, strict=True) if not g)))
    for block_bytes in (1 << 22, 2000, 300):
        got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in without_repeats(docs, 20, block_bytes).collect()]
        assert sorted(got, key=str) == sorted(want, key=str), block_bytes
    assert sum(x[2] for x in want) >= 25 * 30
