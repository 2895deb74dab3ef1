"""Removing repeated passages, exact, by level-wise doubling.

Level 1 looks at windows of `least / 2` words, level 2 at twice that. A window of `least` words can
only repeat if the half-length windows in it do; of those, the one with the least hash is the same in
both copies, so only these are counted at level 1. Where the least one is alone, the whole window is
alone. Survivors are extended to `least` words, and of each word sequence all starts but the first are
removed.

Documents are dealt to blocks by ranges of a hash of doc_id and text. A block asks for each different hash once; it
resolves repeats inside itself, so a passage with a third of all rows costs a row a block. A sequence
is known by 128 bits. No list is collected anywhere; what a task holds is one block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Words, block_count, slices, string_buffers, texts, windows

BLOCK_BYTES = 4 << 20
LAST = (1 << 63) - 1


class Block:
    """Words of the documents of a block in order of doc_id (nulls last), then of the hash of id and text, then text."""

    def __init__(self, table: pa.Table, least: int):
        order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("key", "ascending"), ("text", "ascending")])
        self.table = table.take(order)
        self.ids = pc.fill_null(self.table.column("doc_id"), LAST).to_numpy()
        data, offsets = string_buffers(self.table.column("text"))
        first, second, counts = [], [], []
        for _, _, d, o in slices(data, offsets):
            w = Words(d, o, wide=True)
            first.append(w.hash)
            second.append(w.hash2)
            counts.append(np.diff(w.offsets))
        one = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.a, self.b, self.counts = one(first, np.uint64), one(second, np.uint64), one(counts, np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)
        self.least = least

    def starts(self, n: int) -> np.ndarray:
        """Places of the first words of all windows of n words."""
        ok = np.zeros(len(self.a) + 1, np.int64)
        has = self.counts >= n
        np.add.at(ok, self.offsets[:-1][has], 1)
        np.add.at(ok, self.offsets[1:][has] - n + 1, -1)
        return np.flatnonzero(np.cumsum(ok)[:-1] > 0)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of full windows, the least half-length hash in each, all half-length hashes)."""
        half = self.least // 2
        at = self.starts(self.least)
        h = windows(self.a, half)
        if not len(at):
            return at, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        low, span, wanted = h, 1, self.least - half + 1
        while span * 2 <= wanted:
            low = np.minimum(low[: len(low) - span], low[span:])
            span *= 2
        if span < wanted:
            low = np.minimum(low[: len(low) - (wanted - span)], low[wanted - span :])
        return at, low[at], h[self.starts(half)]

    def locally_repeated(self, every: np.ndarray) -> np.ndarray:
        s = np.sort(every)
        return np.unique(s[1:][s[1:] == s[:-1]])

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, side="right") - 1

    def sequences(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, second hash, whether it is the first of its kind in the block) of the windows at `at`."""
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
        a, b = windows(self.a, self.least)[at], windows(self.b, self.least)[at]
        order = np.lexsort((at, b, a))
        new = np.ones(len(at), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        first = np.zeros(len(at), bool)
        first[order] = new
        return a, b, first


def _among(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)] == values


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64).view(np.uint64)


def without_repeats(docs: DataFrame, least: int = 20, block_bytes: int = BLOCK_BYTES, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with_text, kept (the words left, joined by a space) of every row.

    A word goes if a window of `least` words that holds it also starts earlier: in a smaller doc_id or
    earlier in the same document. Null and empty texts have no words. Rows of one doc_id follow each
    other by a hash of id and text, null ids come last; the order, and so the result, does not depend on
    block_bytes. An empty table gives an empty result; other columns are not read."""
    if least % 2:
        raise ValueError("least must be even: it is reached by doubling")
    base = texts(docs)
    n = block_count(base, block_bytes)
    # blocks are ranges of the hash, so rows of one id that lie in different blocks are in the order of the blocks
    key = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)
    dealt = base.withColumn("key", key).withColumn("block", F.shiftright(F.shiftright("key", 32) * F.lit(n).cast("long"), 31).cast("int"))

    def ask(table: pa.Table) -> pa.Table:
        b = Block(table, least)
        _, low, _ = b.anchors()
        u = np.unique(low)
        return pa.table({"h": pa.array(u.view(np.int64)), "block": pa.array(np.full(len(u), table.column("block")[0].as_py(), np.int32))})

    def extend(table: pa.Table, met: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "doc": pa.array([], pa.int64()), "block": pa.array([], pa.int32())})
        b = Block(table, least)
        at, low, every = b.anchors()
        live = np.union1d(_column(met, "h"), b.locally_repeated(every))
        at = at[_among(low, live)]
        x, y, first = b.sequences(at)
        doc = b.ids[b.doc_of(at[first])]
        return pa.table({"a": pa.array(x[first].view(np.int64)), "b": pa.array(y[first].view(np.int64)), "doc": pa.array(doc.astype(np.int64)), "block": pa.array(np.full(int(first.sum()), table.column("block")[0].as_py(), np.int32))})

    def remove(table: pa.Table, seen: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _result([], [], [], [], with_text)
        b = Block(table, least)
        at = b.starts(least)
        x, y, first = b.sequences(at)
        go = ~first
        if seen.num_rows:
            p, q = _column(seen, "a"), _column(seen, "b")
            order = np.argsort(p, kind="stable")
            p, q = p[order], q[order]
            maybe = np.flatnonzero(first & _among(x, p))
            lo, hi = np.searchsorted(p, x[maybe]), np.searchsorted(p, x[maybe], side="right")
            go[maybe] |= np.array([bool((q[s:e] == v).any()) for s, e, v in zip(lo, hi, y[maybe], strict=True)], bool) if len(maybe) else False
        cover = np.zeros(len(b.a) + 1, np.int64)
        np.add.at(cover, at[go], 1)
        np.add.at(cover, at[go] + least, -1)
        gone = np.cumsum(cover)[:-1] > 0
        removed, kept = [], []
        for k, text in enumerate(b.table.column("text").to_pylist()):
            mask = gone[b.offsets[k] : b.offsets[k + 1]]
            words = text.encode().split()
            left = words if not mask.any() else [words[i] for i in np.flatnonzero(~mask).tolist()]
            removed.append(int(mask.sum()))
            kept.append(b" ".join(left))
        return _result(b.table.column("doc_id"), b.counts, removed, kept, with_text)

    keyed = lambda df: df.groupBy("block")
    alone = Window.partitionBy("h")
    met = keyed(dealt).applyInArrow(ask, "h long, block int").withColumn("n", F.count(F.lit(1)).over(alone)).where("n > 1").select("h", "block")
    same = Window.partitionBy("a", "b")
    firsts = keyed(dealt).cogroup(keyed(met)).applyInArrow(extend, "a long, b long, doc long, block int")
    seen = firsts.withColumn("first", F.min(F.struct("doc", "block")).over(same)).where("struct(doc, block) > first").select("a", "b", "block")
    return keyed(dealt).cogroup(keyed(seen)).applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else ""))


def _result(ids, n_words, n_removed, kept: list[bytes], with_text: bool) -> pa.Table:
    digests = [hashlib.sha256(k).hexdigest() for k in kept]
    ids = ids if isinstance(ids, pa.ChunkedArray) else pa.array(ids, pa.int64())
    out = {"doc_id": ids, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
    return pa.table(out | {"kept": pa.array([k.decode() for k in kept], pa.string())} if with_text else out)
