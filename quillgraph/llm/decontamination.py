"""Benchmark decontamination by greedy string tiling.

Runs of `least` words that an item shares with a document are the seeds, found by joining rolling
hashes of both. Per document and item, matches are extended along their diagonal, and the longest one
that touches no marked word is marked, again and again, until none of `least` words is left (running
Karp-Rabin greedy string tiling). A passage whose parts were put in another order is still covered by
its tiles. A pair counts where the tiles cover at least `threshold` of the item's words.

The index of seeds is broadcast in blocks of items whose size is bounded by INDEX_WORDS; a larger
benchmark takes several passes over the documents.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, string_buffers, texts, windows, word_slices

LEAST, THRESHOLD = 5, 0.5
#: Words of the items of one block: about 50 bytes each in the broadcast index.
INDEX_WORDS = 1_000_000
#: Seed pairs (40 bytes each) held at once; what is kept of them are runs, so a text and an item that both repeat
#: one seed cost a run a diagonal.
SEED_PAIRS = 1 << 19


@dataclass
class Index:
    ids: list[int | None]
    words: list[np.ndarray]  # hashes of each item's words
    #: For each seed length (`least`, and the lengths of shorter items): sorted seed hashes with (item, position).
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def build(items: list[tuple[int | None, str]], least: int) -> Index:
    data, offsets = string_buffers(pa.array([t for _, t in items], pa.string()))
    w = Words(data, offsets, lower=True)
    words = [w.hash[w.offsets[k] : w.offsets[k + 1]] for k in range(len(items))]
    found: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
    for k, h in enumerate(words):
        if len(h):
            n = min(least, len(h))
            found[n].append((windows(h, n), k))
    seeds = {}
    for n, parts in found.items():
        key = np.concatenate([s for s, _ in parts])
        item = np.concatenate([np.full(len(s), k, np.int64) for s, k in parts])
        place = np.concatenate([np.arange(len(s), dtype=np.int64) for s, _ in parts])
        order = np.argsort(key, kind="stable")
        seeds[n] = (key[order], item[order], place[order])
    return Index([i for i, _ in items], words, seeds)


def runs(parts: list[np.ndarray]) -> np.ndarray:
    """Rows (text, item, document place less item place, first and last item place): neighbouring seeds on a diagonal as one.

    parts: such rows, where a run may go on in another part."""
    rows = np.concatenate(parts) if parts else np.zeros((0, 5), np.int64)
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1) | (rows[1:, 3] != rows[:-1, 4] + 1)
    first = np.flatnonzero(new)
    out = rows[first].copy()
    out[:, 4] = rows[np.append(first[1:], len(rows)) - 1, 4]
    return out


def tiles(found: list[tuple[int, int, int]], n: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (item place, document place, words) of at least n words from the matches, which have that form too."""
    heap = [(-size, i, j) for i, j, size in found]
    heapq.heapify(heap)
    in_item: set[int] = set()
    in_doc: set[int] = set()
    out = []
    while heap:
        size, i, j = heapq.heappop(heap)
        free = [k for k in range(-size) if i + k not in in_item and j + k not in in_doc]
        if len(free) == -size:
            out.append((i, j, -size))
            in_item.update(range(i, i - size))
            in_doc.update(range(j, j - size))
            continue
        a = b = None
        for k in [*free, None]:  # what is left of the match, in runs of at least n words
            if a is not None and (k is None or k != b + 1):
                if b - a + 1 >= n:
                    heapq.heappush(heap, (-(b - a + 1), i + a, j + a))
                a = None
            if k is not None:
                a = k if a is None else a
                b = k
    return out


def _shared(w: Words, index: Index, n: int, most: int) -> Iterator[np.ndarray]:
    """Runs of the seeds of n words that texts and items share, from at most `most` seed pairs at a time."""
    keys, item, place = index.seeds[n]
    h = windows(w.hash, n)
    if not len(h):
        return
    mask = np.uint64((1 << 20) - 1)
    sieve = np.zeros(1 << 20, bool)
    sieve[(keys & mask).astype(np.int64)] = True
    at = np.flatnonzero(sieve[(h & mask).astype(np.int64)])
    low, high = np.searchsorted(keys, h[at]), np.searchsorted(keys, h[at], side="right")
    row = np.searchsorted(w.offsets, at, side="right") - 1
    keep = (high > low) & (at + n <= w.offsets[row + 1])
    at, low, row, many = at[keep], low[keep], row[keep], (high - low)[keep]
    ends = np.cumsum(many)
    i = 0
    while i < len(at):
        done = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, done + most, side="right")))  # one place of a text at least
        count = many[i:j]
        k = np.repeat(low[i:j], count) + np.arange(ends[j - 1] - done) - np.repeat(ends[i:j] - count - done, count)
        r, there = np.repeat(row[i:j], count), place[k]
        yield runs([np.column_stack((r, item[k], np.repeat(at[i:j] - w.offsets[row[i:j]], count) - there, there, there))])
        i = j


def _matches(column: pa.Array, index: Index, most: int = SEED_PAIRS) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(row, item, tiles) for every text and item that share a seed."""
    for first, _, w, _, _ in word_slices(column, lower=True):
        for n in index.seeds:
            found = runs(list(_shared(w, index, n, most)))
            cuts = np.flatnonzero((found[1:, :2] != found[:-1, :2]).any(axis=1)) + 1 if len(found) else []
            for own in np.split(found, cuts) if len(found) else ():
                matches = zip(own[:, 3].tolist(), (own[:, 3] + own[:, 2]).tolist(), (own[:, 4] - own[:, 3] + n).tolist(), strict=True)
                yield first + int(own[0, 0]), int(own[0, 1]), tiles(list(matches), n)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """Items in blocks of about INDEX_WORDS words, the only part of the benchmark on the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / 2 / INDEX_WORDS))
    for k in range(n):
        yield [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, longest, first_word, end_word of every pair at or above the threshold.

    Words are runs of non-space, A-Z in lower case. first_word and end_word bound the tiles in the
    document. Null or empty texts and items match nothing; items shorter than `least` words must be met
    whole. Repeated documents each give their rows, repeated items (same id and text) one. An empty
    table on either side gives an empty result. Other columns are not read."""
    schema = "doc_id long, item_id long, coverage double, n_tiles long, longest long, first_word long, end_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    for items in _blocks(benchmark):
        if not items:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(build(items, least))  # at most about INDEX_WORDS seeds

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                rows = []
                for r, k, found in _matches(batch.column("text"), index):
                    covered = sum(n for _, _, n in found) / len(index.words[k])
                    if found and covered >= threshold:
                        rows.append((ids[r], index.ids[k], covered, len(found), max(n for _, _, n in found), min(j for _, j, _ in found), max(j + n for _, j, n in found)))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 7
                kinds = [pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "coverage", "n_tiles", "longest", "first_word", "end_word"])

        out = out.unionByName(texts(docs).mapInArrow(run, schema))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose doc_id has no pair at the threshold; rows with a null id stay."""
    return docs.join(leaks(docs, benchmark, least, threshold).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
