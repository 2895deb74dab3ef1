"""Toxic passages as maximum-scoring segments over token log-odds.

Training counts, in a bounded labelled sample, the different words of each toxic and clean text, by
word and by word beginning; log-odds with a Dirichlet prior give the tokens their scores, kept where
they are significant, and every other token costs `drift`. A linear scan finds all maximal scoring
segments of a text. Their scores follow an extreme-value law: the chance that a clean text of n
tokens holds a segment of score S is 1 - exp(-K n exp(-lambda S)). The logarithm of that expected
number, calibrated on the sample's labels, is the text's score.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, checkpointed, mix, slices, string_buffers, texts

#: Most labelled rows of a class that the model is fitted on (a sample by hash, the same on every run).
SAMPLE_TOXIC, SAMPLE_CLEAN = 6_000, 12_000
#: Bytes of the word beginnings that are features beside the whole word.
BEGINNINGS = (6, 7, 8)
PRIOR, LEAST_COUNT, LEAST_Z, DRIFT = 1.0, 4, 3.5, 0.03

_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 or b == 39 else 32 for b in range(256))


@dataclass
class Model:
    keys: np.ndarray  # sorted feature hashes with a positive score
    scores: np.ndarray
    rate: float = 1.0  # lambda
    scale: float = 1.0  # K
    slope: float = 1.0
    shift: float = 0.0


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts as bytes with a space for every ASCII character that is not a letter."""
    low = [t.lower().encode("utf-8", "replace").translate(_LETTERS) for t in column.to_pylist()]
    offsets = np.zeros(len(low) + 1, np.int64)
    np.cumsum([len(b) for b in low], out=offsets[1:])
    return np.frombuffer(b"".join(low), np.uint8), offsets


def _features(w: Words, data: np.ndarray) -> list[np.ndarray]:
    """Hashes of each word and of its beginnings; a beginning of the whole word's length is left to the word."""
    found = [w.hash]
    if not len(w):
        return found * (1 + len(BEGINNINGS))
    for n in BEGINNINGS:
        h = np.full(len(w), n, np.uint64)
        for k in range(n):
            at = np.minimum(w.starts + k, w.ends - 1)
            h = h * np.uint64(0x100000001B3) + np.where(w.starts + k < w.ends, data[at], 0).astype(np.uint64) + np.uint64(1)
        h = mix(h)
        h[w.ends - w.starts <= n] = 0
        found.append(h)
    return found


def remainder(doc_id: str, n: int) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of at most SAMPLE_TOXIC + SAMPLE_CLEAN labelled rows outside the held-out third."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.where(remainder("doc_id", 3) != 1)
    chosen = None
    for value, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        part = marks.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = checkpointed(chosen)
    return texts(docs).join(F.broadcast(chosen), "doc_id").select("text", "toxic")  # of a bounded number of ids


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, toxic and a digest of the text's words in order."""
    for batch in batches:
        data, offsets = _letters(batch.column("text"))
        whole = data.tobytes()
        digests = [hashlib.blake2b(b" ".join(whole[a:b].split()), digest_size=16).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("toxic"), pa.array(digests, pa.binary())], names=["text", "toxic", "digest"])


def different(rows: DataFrame) -> DataFrame:
    """text, toxic with one row for each sequence of words and label, in any layout."""
    return rows.mapInArrow(_digested, "text string, toxic int, digest binary").dropDuplicates(["digest", "toxic"]).select("text", "toxic")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different words of the texts of each class that have a feature."""
    keys: list[np.ndarray] = []
    marks: list[np.ndarray] = []
    words = [0, 0]
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        data, offsets = _letters(batch.column("text"))
        for i, j, d, o in slices(data, offsets):
            w = Words(d, o)
            features = _features(w, d)
            for k in range(j - i):
                a, b = w.offsets[k], w.offsets[k + 1]
                if b <= a:
                    continue
                at = a + np.unique(w.hash[a:b], return_index=True)[1]
                own = np.concatenate([f[at] for f in features])
                own = own[own != 0]
                words[toxic[i + k]] += len(at)
                keys.append(own)
                marks.append(np.full(len(own), toxic[i + k], np.int64))
    if keys:
        allk, allm = np.concatenate(keys), np.concatenate(marks)
        u, inv = np.unique(allk, return_inverse=True)
        t = np.bincount(inv, weights=allm, minlength=len(u)).astype(np.int64)
        n = np.bincount(inv, minlength=len(u)).astype(np.int64)
        for s in range(0, len(u), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(u[s : s + 50_000].view(np.int64)), pa.array(t[s : s + 50_000]), pa.array(n[s : s + 50_000] - t[s : s + 50_000])], names=["f", "t", "c"])
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([words[1]]), pa.array([words[0]])], names=["f", "t", "c"])


def maximal_segments(places: np.ndarray, scores: np.ndarray, drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first place, last place) of a token sequence whose tokens
    at `places` have positive `scores` and whose others cost `drift`. Linear in the number of places: a
    candidate is linked to the last one before it with a smaller left sum, and the search follows links."""
    out: list[list[float]] = []  # left sum, right sum, first, last, link
    total, before = 0.0, -1
    for p, s in zip(places.tolist(), scores.tolist(), strict=True):
        total -= drift * (p - before - 1)
        item = [total, total + s, p, p, -1]
        total, before = total + s, p
        while True:
            k = len(out) - 1
            while k >= 0 and out[k][0] >= item[0]:
                k = out[k][4]
            if k < 0 or out[k][1] >= item[1]:
                item[4] = k
                out.append(item)
                break
            item[0], item[2] = out[k][0], out[k][2]
            del out[k:]
    return [(r - a, int(i), int(j)) for a, r, i, j, _ in out]


def _damped(words: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The r-th time that a text says the same word counts 1/r of its score."""
    times: dict[int, int] = {}
    out = scores.copy()
    for k, h in enumerate(words.tolist()):
        times[h] = r = times.get(h, 0) + 1
        out[k] /= r
    return out


def _segments(column: pa.Array, m: Model) -> Iterator[tuple[int, list[tuple[float, int, int]]]]:
    """(tokens, maximal segments) of each text."""
    data, offsets = _letters(column)
    for i, j, d, o in slices(data, offsets):
        w = Words(d, o)
        best = np.zeros(len(w))
        if len(m.keys) and len(w):
            for f in _features(w, d):
                at = np.minimum(np.searchsorted(m.keys, f), len(m.keys) - 1)
                np.maximum(best, np.where(m.keys[at] == f, m.scores[at], 0.0), out=best)
        hits = np.flatnonzero(best)
        ends = np.searchsorted(hits, w.offsets)
        for k in range(j - i):
            a, n = w.offsets[k], int(w.offsets[k + 1] - w.offsets[k])
            own = hits[ends[k] : ends[k + 1]]
            yield n, maximal_segments(own - a, _damped(w.hash[own], best[own]), DRIFT) if len(own) else []


def _evidence(n: int, score: float, m: Model) -> float:
    """-log10 of the expected number of segments of at least this score in a clean text of n tokens."""
    return (m.rate * score - math.log(m.scale * max(n, 1))) / math.log(10)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    spark = docs.sparkSession
    rows = training_rows(docs, labels)
    counts = different(rows).mapInArrow(_count, "f long, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counts = checkpointed(counts.where(f"f = 0 or t >= {LEAST_COUNT}"))
    sizes = counts.where("f = 0").first()
    nt, nc = (sizes.t, sizes.c) if sizes else (0, 0)
    y = lambda c: F.col(c) + F.lit(PRIOR)
    odds = F.log(y("t") / (F.lit(nt + 2 * PRIOR) - F.col("t"))) - F.log(y("c") / (F.lit(nc + 2 * PRIOR) - F.col("c")))
    kept = counts.where("f <> 0").withColumn("odds", odds).where((F.col("odds") > 0) & (F.col("odds") / F.sqrt(1 / y("t") + 1 / y("c")) >= LEAST_Z))
    found = sorted((r.f & ((1 << 64) - 1), r.odds) for r in kept.select("f", "odds").collect())  # at most the sample's words / LEAST_COUNT
    m = Model(np.array([f for f, _ in found], np.uint64), np.array([s for _, s in found], float))
    shared = spark.sparkContext.broadcast(m)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(_segments(batch.column("text"), shared.value))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([n for n, _ in got], pa.int64()), pa.array([max((s[0] for s in g), default=0.0) for _, g in got], pa.float64()), pa.array([sum(b - a + 1 for _, a, b in g) for _, g in got], pa.int64())], names=["toxic", "n", "best", "inside"])

    seen = rows.mapInArrow(measure, "toxic int, n long, best double, inside long").toPandas()  # one row a sampled text
    seen = seen.sort_values(["toxic", "n", "best"])  # sums do not depend on the layout
    return calibrated(m, seen["toxic"].to_numpy(), seen["n"].to_numpy(), seen["best"].to_numpy())


def calibrated(m: Model, toxic: np.ndarray, n: np.ndarray, best: np.ndarray) -> Model:
    """lambda from the clean texts' score distribution, K from their maxima, then a logistic fit of the labels."""
    clean = toxic == 0
    if clean.any() and len(m.keys):
        tokens = float(n[clean].sum()) + 1.0
        hits = best[clean][best[clean] > 0]
        p = (len(hits) + 0.5) / tokens  # chance of a scoring token in clean text
        s = float(hits.mean()) if len(hits) else float(np.median(m.scores))
        low, high = 1e-3, 50.0
        for _ in range(100):  # the positive root of p e^(x s) + (1 - p) e^(-x drift) = 1
            x = (low + high) / 2
            low, high = (low, x) if p * math.exp(min(x * s, 700)) + (1 - p) * math.exp(-x * DRIFT) > 1 else (x, high)
        m.rate = low
        seen = max(len(hits), 0.5)  # K makes the expected number of scoring clean texts the observed one
        m.scale = seen / max(float((n[clean]).sum()), 1.0) * math.exp(min(m.rate * s, 700))
    x = np.array([_evidence(int(a), float(b), m) for a, b in zip(n, best, strict=True)])
    if len(x) == 0 or toxic.min() == toxic.max():
        m.slope, m.shift = 1.0, -3.0
        return m
    mean, sd = x.mean(), x.std() + 1e-9
    z, a, b = (x - mean) / sd, 0.0, 0.0
    for _ in range(60):  # Newton with a small ridge
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        v, e = q * (1 - q), toxic - q
        g = np.array([(e * z).sum() - 0.5 * a, e.sum()])
        h = np.array([[(v * z * z).sum() + 0.5, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
    m.slope, m.shift = max(a, 0.0) / sd, b - max(a, 0.0) * mean / sd
    return m


def _probability(n: int, best: float, m: Model) -> float:
    return 1 / (1 + math.exp(-min(max(m.slope * _evidence(n, best, m) + m.shift, -30), 30)))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, whose score is under the threshold. Null and empty texts stay."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            column = batch.column("text").fill_null("")
            keep = [_probability(n, max(got, default=(0.0,))[0], m) < threshold for n, got in _segments(column, m)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, n_segments (significant ones), first_word, last_word of the best.

    Null and empty texts have no segment and score as such. A null id counts as not held out. Repeated
    rows score alike. Without labels of both classes the score comes from the segments alone. Other
    columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            score, count, first, last = [], [], [], []
            for n, got in _segments(batch.column("text"), m):
                best = max(got, default=(0.0, -1, -1))
                score.append(_probability(n, best[0], m))
                count.append(sum(_evidence(n, s, m) >= 1 for s, _, _ in got))
                first.append(best[1])
                last.append(best[2])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64()), pa.array(count, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=["doc_id", "score", "n_segments", "first_word", "last_word"])

    rows = texts(docs).mapInArrow(run, "doc_id long, score double, n_segments long, first_word long, last_word long")
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_segments", "first_word", "last_word")
