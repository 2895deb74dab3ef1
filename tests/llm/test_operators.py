import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import pytest

from .helpers import WORD, components, documents, low, nothing, sample, shingles


def rows(df, *key):
    return {tuple(r[k] for k in key) if len(key) > 1 else r[key[0]]: r for r in df.collect()}


def test_lm_scores_count_exactly_in_any_blocks(spark):
    from quillgraph.llm.lm_scoring import lm_scores

    docs = documents(spark)
    one = rows(lm_scores(docs), "doc_id")
    many = rows(lm_scores(docs, block_bytes=1500), "doc_id")
    tokens = {r.doc_id: WORD.findall(low(r.text or "")) + ["\0"] for r in docs.collect()}
    train = [k for k in tokens if zlib.crc32(str(k).encode()) % 5 != 1]
    c = Counter(w for k in train for w in tokens[k])
    n, v = sum(c.values()), len(c)
    for k, w in tokens.items():
        want = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        for got in (one[k], many[k]):
            assert (got.held_out, got.n_tokens, got.n_known, got.train_tokens) == (k not in train, len(w), sum(c[x] > 0 for x in w), n)
            assert got.base_score == pytest.approx(want)
        assert one[k].score == pytest.approx(many[k].score) and one[k].score < 0
    assert lm_scores(nothing(spark)).count() == 0


def brute_model(texts, order):
    """p(w | words before) of the interpolated model with its counts in dictionaries; and the known words."""
    lines = [["<s>", *WORD.findall(low(t)), "</s>"] for t in texts]
    c = Counter(tuple(x[i - n + 1 : i + 1]) for x in lines for n in range(1, order + 1) for i in range(max(n - 1, 1), len(x)))
    c[("<s>",)] = len(lines)
    bucket = lambda k: math.floor(math.log2(k)) + 1
    once, every = Counter(), Counter()
    for g, k in c.items():
        if len(g) > 1:
            once[len(g), bucket(c[g[:-1]])] += k == 1
            every[len(g), bucket(c[g[:-1]])] += k
    words = [g for g in c if len(g) == 1 and g != ("<s>",)]
    n1, n2, total = sum(c[g] == 1 for g in words), sum(c[g] == 2 for g in words), sum(c[g] for g in words)
    cut = min(max(n1 / max(n1 + 2 * n2, 1), 0.1), 0.95)

    def p(w, before):
        if not before:
            return (c[w,] - cut) / total if c[w,] else cut * len(words) / total
        if not c[before]:
            return p(w, before[1:])
        key = len(before) + 1, bucket(c[before])
        left = min(max((once[key] + 1) / (every[key] + 2), 0.02), 0.999)
        return (1 - left) * c[(*before, w)] / c[before] + left * p(w, before[1:])

    return p, [w for (w,) in words]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_scores_equal_a_brute_force_model(spark, monkeypatch, order):
    from quillgraph.llm import lm_scoring

    monkeypatch.setattr(lm_scoring, "SEGMENT", 7)
    docs = documents(spark, [*sample(40, seed=2), "a b " * 50, "zz new words a b"])
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    p, known = brute_model([t for k, t in texts.items() if zlib.crc32(str(k).encode()) % 5 != 1], order)
    got = rows(lm_scoring.lm_scores(docs, order=order, block_bytes=900), "doc_id")
    for k, t in texts.items():
        x = ["<s>", *WORD.findall(low(t)), "</s>"]
        want = sum(math.log10(p(x[i], tuple(x[max(0, i - order + 1) : i]))) for i in range(1, len(x)))
        assert got[k].score == pytest.approx(want), (k, t)
    for before in ((), ("a",), ("<s>", "a"), ("a", "b")):  # the weights after a state add up to one, with the unknown word's
        assert sum(p(w, before[-order + 1 :] if order > 1 else ()) for w in [*known, "never seen"]) == pytest.approx(1)


def test_leaks_are_found_in_any_order_of_their_parts(spark):
    from quillgraph.llm.decontamination import leaks, tiles, without_leaks

    rnd = random.Random(3)
    w = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    item = w(24)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(w(20))), (3, None), (4, ""), (4, "tiny one")], "item_id long, text string")
    texts = [" ".join([*w(30), *item, *w(30)]), " ".join([*w(9), *item[12:], *w(9), *item[:12], *w(5)]), " ".join(w(200)), " ".join(item[:8] + w(50)), "So TINY one here", None, " ".join(item).upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows(leaks(docs, bench), "doc_id", "item_id")
    assert set(got) == {(0, 1), (1, 1), (4, 4), (6, 1)}
    assert got[1, 1].n_tiles == 2 and got[0, 1].longest == 24 and got[0, 1].first_word == 30
    assert sorted(r.doc_id for r in without_leaks(docs, bench).collect()) == [2, 3, 5]
    assert leaks(docs.limit(0), bench).count() == 0 and leaks(docs, bench.limit(0)).count() == 0
    assert tiles([(0, 10, 4), (0, 30, 3)], 3) == [(0, 10, 4)]


def _plain_tiles(item, doc, least):
    """Greedy string tiling as it is written down: the longest unmarked match first, then the first places."""
    out, a, b = [], set(), set()
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and i + k not in a and j + k not in b:
                    k += 1
                best = max(best, (k, -i, -j))
        k, i, j = best[0], -best[1], -best[2]
        if k < least:
            return out
        out.append((i, j, k))
        a.update(range(i, i + k))
        b.update(range(j, j + k))


def test_tiles_equal_plain_tiling_on_repetitive_texts():
    import numpy as np
    import pyarrow as pa

    from quillgraph.llm.decontamination import _matches, build

    rng = np.random.default_rng(5)
    items = [" ".join(rng.choice(["a", "b"], 40)), "a " * 30, " ".join(rng.choice(list("abcdef"), 60)), "a b"]
    docs = ["a " * 70, " ".join(rng.choice(["a", "b"], 90)), items[2] + " x " + items[0], "", " ".join(rng.choice(list("abcdef"), 150))]
    index = build(list(enumerate(items)), 3)
    for most in (1, 7, 1 << 19):  # runs that go over from one part to the next are put together
        got = {(r, k): t for r, k, t in _matches(pa.array(docs), index, most)}
        for r, d in enumerate(docs):
            for k, t in enumerate(items):
                words = t.split()
                assert got.get((r, k), []) == _plain_tiles(words, d.split(), min(3, len(words))), (r, k)


def test_one_repeated_word_costs_a_run_a_diagonal():
    import tracemalloc

    import pyarrow as pa

    from quillgraph.llm.decontamination import _matches, build

    index = build([(0, "the " * 400)], 5)
    tracemalloc.start()
    start = time.time()
    ((_, _, found),) = list(_matches(pa.array(["the " * 20_000]), index))
    assert found == [(0, 0, 400)] and time.time() - start < 60 and tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()


def test_base_spans_match_the_rules():
    from quillgraph.llm.pii import base_spans, luhn

    e, i = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    c, p = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda s: re.sub(r"\D", "", s)

    def brute(t):
        out = [("email", *m.span()) for m in e.finditer(t)]
        out += [("ip", *m.span()) for m in i.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
        out += [("card", *m.span()) for m in c.finditer(t) if 13 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
        return out + [("phone", *m.span()) for m in p.finditer(t) if 9 <= len(digits(m.group())) <= 15]

    rnd = random.Random(7)
    for _ in range(3000):
        t = "".join(rnd.choice("0123456789.-+() @aZ_%é\n") for _ in range(rnd.randint(0, 60)))
        assert sorted(base_spans(t)) == sorted(brute(t)), t


def test_personal_data_and_masks(spark):
    from quillgraph.llm.pii import masked, personal_data

    texts = ["mail joe.1@mail3.example.com or 10.0.0.255, 4111 1111 1111 1111 and +1 (017) 555-7713.", "write bob (at) example (dot) com please, card 5927243074273351 ok", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" version 3.1.2', "call (017) 555-7713 x"]
    docs = documents(spark, texts)
    got = rows(personal_data(docs), "doc_id")
    assert (got[0].n_email, got[0].n_ip, got[0].n_card, got[0].n_phone) == (1, 1, 1, 1)
    assert got[1].n_email == 0 and "email:6:32" in got[1].spans and "card:" in got[1].spans
    assert got[2].spans == "" and "phone:" in got[3].spans
    assert got[4].spans == got[5].spans == "" and got[4].base_sha256 == hashlib.sha256(b"").hexdigest()
    said = rows(masked(docs), "doc_id")
    assert said[0].text == "mail <email> or <ip>, <card> and <phone>." and said[4].text is None and said[2].text == texts[2]
    assert personal_data(nothing(spark)).count() == 0 and masked(docs).columns == docs.columns


def test_main_text_of_held_out_pages(spark):
    from quillgraph.llm.html_text import _page, beliefs, page_texts, parse, weights

    w, rnd, right, wrong = dict(weights()), random.Random(1234), 0, 0
    for _ in range(60):
        nodes, blocks = parse(_page(rnd), labelled=True)
        full = beliefs(nodes, w)[0]
        for k, _ in blocks:
            hit = (full[k] > 0) == bool(max(nodes[k].label, 0))
            right, wrong = right + hit, wrong + (not hit)
    assert right / (right + wrong) > 0.98
    page = '<html><head><title>T</title><script>x="</p>"</script></head><body><nav><ul><li><a href=a>Home</a></li></ul></nav><div class="ad">Buy this now.</div><article><h1>Head &amp; tail</h1><p><b>First\n  part.<br>Second part.<p>Last one &lt;here&gt;.</article><footer>&copy; x</footer></body>'
    pages = spark.createDataFrame([(1, "u", page, "clash"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "<p", "x"), (1, "u", page, "x")], "page_id long, url string, html string, text string")
    got = page_texts(pages).collect()
    assert [r.text for r in got if r.page_id == 1] == ["Head & tail First part. Second part. Last one <here>."] * 2
    assert all(r.n_chars == len(r.text) for r in got) and len(got) == 5


@pytest.mark.parametrize("part", ["<b></i>", "<!-- x", "<a \"", "<a b='", "<p", "<li><b>", "</p><p><i>", "&amp;<"])
def test_bad_markup_is_read_in_linear_time(part):
    from quillgraph.llm.html_text import parse

    def seconds(n):
        page = "<p>Start here.</p>" + part * n + "<p>And <b>end</b>.</p>"
        return min(_timed(parse, page) for _ in range(3))

    parse("<p>x</p>")
    assert seconds(32_000) < 40 * seconds(2_000) + 0.2  # 16 times as much; the square would be 256


def _timed(f, *args):
    start = time.perf_counter()
    f(*args)
    return time.perf_counter() - start


def test_many_spread_hits_are_read_in_linear_time():
    import numpy as np

    from quillgraph.llm.toxicity import maximal_segments

    cost = lambda n: min(_timed(maximal_segments, np.arange(n) * 200, np.ones(n) - np.arange(n) / n, 0.03) for _ in range(3))
    assert cost(64_000) < 40 * cost(4_000) + 0.2


def test_spans_that_the_model_adds():
    """On held-out sentences: precision and recall of the spans beside those of the plain rules."""
    from quillgraph.llm.pii import _sentence, spans, weights

    rnd, v, hit, made, there = random.Random(99), weights(), 0, 0, 0
    for _ in range(500):
        text, marks = _sentence(rnd)
        base, full = spans(text, v)
        new, wanted = set(full) - set(base), set(marks) - set(base)
        hit, made, there = hit + len(new & wanted), made + len(new), there + len(wanted)
    assert hit / made > 0.9 and hit / there > 0.85, (hit, made, there)
    wrong = "order 4111111111111112 and 1234567812345678 in stock"
    assert spans(wrong, v)[1] == []
    far = "x" * 300 + ".y (at) mail (dot) example (dot) org"
    assert spans(far, v)[1] == [("email", 0, len(far))]


def test_fingerprints_and_edits(spark):
    from quillgraph.llm.fingerprints import edited_fingerprints

    texts = ["Straße  ONE", "STRASSE one", "ﬁve 日本", "five 日本", "other text here"]
    docs = documents(spark, texts)
    got = rows(edited_fingerprints(docs), "doc_id")
    assert got[0].fingerprint == got[1].fingerprint != got[2].fingerprint == got[3].fingerprint
    assert got[5].fingerprint == got[6].fingerprint == got[7].fingerprint and got[5].near_edited == 1.0
    full = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(full, reverse=True)
    for at, k in enumerate(order):
        t, nxt = full[k], full[order[(at + 1) % len(order)]]
        m = len(t) // 3
        assert got[k].n_chars == len(t) and got[k].edited_sha256 == hashlib.sha256((t[: len(t) - m] + nxt[:m]).encode()).hexdigest()
    assert got[1].near_next == 1.0 and got[2].near_next == 0.0
    assert edited_fingerprints(nothing(spark)).count() == 0
    assert edited_fingerprints(docs.union(docs.limit(2)).union(docs.limit(1).selectExpr("cast(null as bigint)", *docs.columns[1:]))).count() == 11


def test_next_document_across_ranges(spark, monkeypatch):
    from quillgraph.llm import fingerprints

    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 200)
    ids = [k * k * 3 - 50 for k in range(43)]
    docs = documents(spark, sample(40), ids)
    got = rows(fingerprints.fingerprints(docs), "doc_id")
    full = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(full, reverse=True)
    assert len(got) == 43 and all(got[k].next_text == full[order[(at + 1) % 43]] for at, k in enumerate(order))


def brute_repeats(texts, least):
    seen, out = set(), {}
    for k in sorted(texts):
        w = WORD.findall(texts[k] or "")
        gone = [False] * len(w)
        for s in range(len(w) - least + 1):
            x = tuple(w[s : s + least])
            if x in seen:
                gone[s : s + least] = [True] * least
            seen.add(x)
        out[k] = (len(w), sum(gone), " ".join(a for a, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 22, 900])
def test_repeats_are_removed_exactly(spark, block_bytes):
    from quillgraph.llm.substrings import without_repeats

    texts = [*sample(50, seed=5), "For " * 60, "For " * 45 + "x"]
    docs = documents(spark, texts)
    want = brute_repeats({r.doc_id: r.text for r in docs.collect()}, 20)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in without_repeats(docs, 20, block_bytes).collect()}
    assert got == want and any(x[1] for x in want.values())
    assert without_repeats(nothing(spark)).count() == 0


def test_mix_meets_targets(spark):
    from quillgraph.llm.mixing import mix_blocks, mix_counts

    docs = documents(spark, [*sample(150, seed=9), "lone words here"], None)
    got = mix_counts(docs, block_words=4, shard_slots=16).collect()
    assert len(got) == docs.count() and all(r.taken <= 3 * r["size"] for r in got)
    size = Counter()
    for r in docs.collect():
        size[r.source] += len(WORD.findall(r.text or ""))
    assert {r.doc_id: r["size"] for r in got} == {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    taken, target = Counter(), {}
    for r in got:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.source_size == size[source[r.doc_id]]
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    free = [s for s in size if target[s] < 3 * size[s] - 1e-6]
    assert len({round(target[s] / weight[s], 6) for s in free}) == 1
    assert all(abs(taken[s] - target[s]) <= max(10, 0.05 * target[s]) for s in size)
    again = {(r.doc_id, r.taken) for r in mix_counts(docs, block_words=4, shard_slots=16).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    blocks = mix_blocks(docs, block_words=4, shard_slots=16).collect()
    assert sum(b.n_words for b in blocks) == sum(r.taken for r in got) and all(len(b.text.split()) == b.n_words for b in blocks)
    assert mix_counts(nothing(spark)).count() == 0


def test_maximal_segments_are_the_best_ones():
    import numpy as np

    from quillgraph.llm.toxicity import maximal_segments

    rnd = random.Random(2)
    for _ in range(200):
        n = rnd.randint(1, 30)
        places = sorted(rnd.sample(range(n), rnd.randint(1, n)))
        scores = [rnd.randint(1, 20) / 10 for _ in places]
        line = [-0.5] * n
        for p, s in zip(places, scores, strict=True):
            line[p] = s
        best = max(sum(line[i:j]) for i in range(n) for j in range(i + 1, n + 1))
        got = maximal_segments(np.array(places), np.array(scores), 0.5)
        assert max(s for s, _, _ in got) == pytest.approx(best)
        assert all(s == pytest.approx(sum(line[i : j + 1])) for s, i, j in got)


def test_toxicity_learns_held_out_words(spark):
    from quillgraph.llm.toxicity import toxicity, without_toxic

    rnd = random.Random(4)
    plain = [f"w{k}x" for k in range(300)]
    plain = ["".join(chr(97 + int(c)) for c in str(k * 7919)) for k in range(400)]
    texts, marks = [], []
    for k in range(240):
        w = [rnd.choice(plain) for _ in range(rnd.randint(10, 60))]
        if k % 4 == 0:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(("Nasty!", "VILE", "nasty,")))
        texts.append(" ".join(w))
        marks.append((k, int(k % 4 == 0)))
    docs, labels = documents(spark, texts), spark.createDataFrame([*marks, (None, 1), (5, None)], "doc_id long, toxic int")
    got = rows(toxicity(docs, labels), "doc_id")
    assert len(got) == 243 and all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in got.items())
    held = [(k, r) for k, r in got.items() if r.held_out and k < 240]
    assert sum(r.predicted == (k % 4 == 0) for k, r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and got[240].predicted == got[241].predicted == 0
    kept = without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if not r.predicted}
    assert toxicity(nothing(spark), labels).count() == 0 and toxicity(docs, labels.limit(0)).count() == 243


def test_toxic_model_does_not_depend_on_the_layout(spark):
    from quillgraph.llm.toxicity import fit

    rnd = random.Random(6)
    plain = ["".join(chr(97 + int(c)) for c in str(k * 7919)) for k in range(200)]
    shared = [rnd.choice(plain) for _ in range(40)]  # so most least shingles are the same
    texts = [" ".join([*shared, *("nasty vile".split() if k % 4 == 0 else []), *(rnd.choice(plain) for _ in range(3))]) for k in range(200)]
    ids, labels = [*range(200)], [(k, int(k % 4 == 0)) for k in range(200)]
    docs, labels = documents(spark, texts, [*ids, 900, 901, 902]), spark.createDataFrame(labels, "doc_id long, toxic int")
    one, many = (fit(docs.repartition(n), labels) for n in (1, 7))
    assert len(one.keys) > 0 and one.keys.tolist() == many.keys.tolist() and one.scores.tolist() == many.scores.tolist()
    assert (one.rate, one.scale, one.slope, one.shift) == (many.rate, many.scale, many.slope, many.shift)
    copies = docs.union(docs)  # copies count once
    assert fit(copies, labels).scores.tolist() == one.scores.tolist()


def test_token_counts_match_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    from quillgraph.llm.token_counts import PrefixCounter, token_counts

    path = str(public.path("byte_bpe_50k.json"))
    t, c = tokenizers.Tokenizer.from_file(path), PrefixCounter(path)
    rnd = random.Random(1)
    alphabet = [*"abcetinosr  \n\t.,'!?0123456789éßñ日本語\x1c\x85\xa0🙂<|>", "'s", "'re", "<|endoftext|>", "the", " and", "ing", "  "]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 50))) for _ in range(400)]
    for x in texts:
        assert c.total(x) == len(t.encode(x, add_special_tokens=False).ids), x
        k = rnd.randint(0, len(x))
        assert c.count_at(x, k) == len(t.encode(x[:k], add_special_tokens=False).ids), (x, k)
    docs = documents(spark, texts)
    got = rows(token_counts(docs, path, limit=20), "doc_id")
    for k, x in enumerate([*texts, "", "", " \t\n"]):
        assert (got[k].n_bytes, got[k].n_tokens) == (len(x.encode()), c.total(x)) and got[k].over_limit == (c.total(x) > 20)


@pytest.mark.parametrize("block_bytes", [1 << 22, 2500])
def test_near_duplicate_components(spark, block_bytes):
    from quillgraph.llm.jaccard_join import near_duplicates, without_near_duplicates

    docs = documents(spark, sample(110, seed=12))
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = components(texts)
    got = rows(near_duplicates(docs, block_bytes), "doc_id")
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == {k: (len(shingles(texts[k])), want[k]) for k in texts}
    if block_bytes == 2500:
        kept = without_near_duplicates(docs, block_bytes)
        assert {r.doc_id for r in kept.collect()} == set(want.values()) and kept.columns == docs.columns
        assert near_duplicates(nothing(spark)).count() == 0


@pytest.mark.parametrize("leaf", [2, 1024])
def test_large_groups_of_near_copies(spark, monkeypatch, leaf):
    """Chains and stars of near copies, in regions split by pivots, cells and guests."""
    from quillgraph.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    monkeypatch.setattr(jaccard_join, "HUB", 5)
    rnd = random.Random(8)
    texts = []
    for group in range(4):
        base = [f"t{group}_{k}" for k in range(120)]
        for _ in range(33):
            w = list(base)
            for _ in range(rnd.randint(0, 5)):
                w[rnd.randrange(12) * 10] = f"u{rnd.randrange(3)}"
            texts.append(" ".join(w))
            if rnd.random() < 0.5:  # the next ones start from this one
                base = w
    docs = documents(spark, texts)
    full = {r.doc_id: r.text for r in docs.collect()}
    got = rows(jaccard_join.near_duplicates(docs, 4000), "doc_id")
    want = components(full)
    assert len(set(want.values())) > 8 and max(Counter(want.values()).values()) > 15
    assert {k: r.component_id for k, r in got.items()} == want


def test_no_link_is_lost_between_large_and_small_sets():
    """Which sets stay open: those of sizes around the limit between the two ways of asking, linked or not."""
    import numpy as np
    import pyarrow as pa

    from quillgraph.llm import jaccard_join

    rnd = random.Random(3)
    texts = []
    for n in range(50, 100):
        w = [f"a{n}_{k}" for k in range(n)]
        texts += [" ".join(w), " ".join(w[: n - rnd.randint(1, n // 6)]), " ".join([*w[: n // 2], *(f"b{n}_{k}" for k in range(n // 2))])]
    t = pa.table({"doc_id": list(range(len(texts))), "text": texts, "block": pa.array([0] * len(texts), pa.int32())})
    said = jaccard_join._tell_shared(jaccard_join._ask_shared(3)(t).sort_by("shard"))
    got = jaccard_join._open_sets(3)(t, said).column("s").to_pylist()
    sets = [shingles(x) for x in texts]
    linked = [any(a is not b and 100 * len(a & b) >= 80 * len(a | b) for b in sets) for a in sets]
    assert all(g is not None for g, x in zip(got, linked, strict=True) if x) and any(linked)
    assert sum(g is None for g in got) > 15 and np.all([len(g) == len(s) for g, s in zip(got, sets, strict=True) if g is not None])


def test_near_duplicates_of_shared_and_null_ids(spark):
    from quillgraph.llm.jaccard_join import near_duplicates, without_near_duplicates

    word = lambda k, n=40: [f"{chr(97 + k)}{i}" for i in range(n)]
    near = lambda k, x: " ".join([*word(k)[:-1], x])
    a, b, c, d = (" ".join(word(k)) for k in range(4))
    texts = [a, b, near(1, "x"), c, near(2, "x"), near(2, "y"), d, near(3, "x"), near(0, "x"), near(0, "y"), ""]
    ids = [5, 5, 9, None, None, None, None, 7, 5, 3, 3, None, 8, None]
    docs = documents(spark, texts, ids).repartition(4)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs).collect())
    want = {(5, 36, 3): 2, (3, 36, 3): 1, (5, 36, 5): 1, (9, 36, 5): 1, (None, 36, None): 3, (None, 36, 7): 1, (7, 36, 7): 1, (3, 0, 3): 1, (None, 0, None): 2, (8, 0, 8): 1}
    assert got == want
    kept = without_near_duplicates(docs)
    left = sorted((str(r.doc_id), r.text or "") for r in kept.collect())
    said = [x for x in left if x[1].strip()]
    assert kept.columns == docs.columns and len(left) == 8 and len(said) == 4
    assert {x for x in said if x[0] != "None"} == {("3", near(0, "y")), ("5", b), ("7", near(3, "x"))}
    assert [x[1].split()[0] for x in said if x[0] == "None"] == ["c0"]
