"""Small tables with the awkward cases, and brute-force twins of operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, block int, size long"


def low(s):
    return s.translate({c: c + 32 for c in range(65, 91)})


def sample(n=60, seed=1):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 4))) for _ in range(60)]
    texts = []
    for _ in range(n):
        kind = rnd.random()
        if texts and kind < 0.15:
            texts.append(rnd.choice(texts))
        elif texts and kind < 0.4:
            w = WORD.findall(rnd.choice(texts)) or ["x"]
            for _ in range(rnd.randint(1, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            texts.append(" ".join(w))
        else:
            texts.append(rnd.choice([" ", "\n", "  "]).join(rnd.choice(words).title() if rnd.random() < 0.2 else rnd.choice(words) for _ in range(rnd.randint(0, 90))))
    return texts


def documents(spark, texts=None, ids=None):
    """The texts with null, empty and blank ones behind, and columns whose names clash with inner ones."""
    texts = [*(texts if texts is not None else sample()), None, "", " \t\n"]
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", None if i and i % 7 == 3 else f"s{(i or 0) % 4}", len(t or ""), "clash", -1, -1) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = WORD.findall(low(text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}
