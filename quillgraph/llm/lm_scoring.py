"""Language-model scores by a weighted backoff automaton.

States are the n-grams of up to order - 1 words of the training texts. A state h has an arc for each word
w seen after it, with the smoothed weight

    p(w | h) = (1 - L(h)) c(h w) / c(h) + L(h) p(w | h'),

and a failure arc of weight L(h) to h', the state without its first word. L(h) is the share of once-seen
continuations among those of states with a like count (by power of two). The empty state has absolute
discounting, whose mass goes to unknown words. A text is read once from left to right: the state that
it has reached is carried on, failure arcs are followed until one has an arc for the next word, and the
logarithms on the way add up. What is reached depends on the last words alone, so pieces of SEGMENT
words are read side by side.

Scale: the counts grow with the corpus and are held nowhere as a whole. Documents are dealt to
blocks. A block asks shards (ranges of the n-grams' hashes) for the training counts of its own n-grams,
once each, and notes at every place those of the n-grams that end there: what the automaton needs
along the block's own texts. A block or shard has a bounded mean size, a shard's keys are different
n-grams of at most all blocks, so no word or n-gram is hot, and there are at most as many messages as
keys. Sums over all texts come from the places, so they are added up by Spark.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, block_count, block_of, mix, slices, string_buffers, texts
from .messages import bits, by_shard, flags, large, pack, small, unpack

BLOCK_BYTES = 8 << 20
#: n-grams that a shard counts on average.
SHARD_KEYS = 3_000_000
BUCKETS, SEGMENT = 48, 128
#: Bits of an n-gram's key beyond those that number all n-grams: one in a million shares its key with another.
SPARE_BITS = 20
#: Blocks that are handed the sums over all texts by one task.
RUN = 1024
END, START = np.uint64(0x1D8E4E27C47D124F), np.uint64(0xEB44ACCAB455D165)
_M = np.uint64(0x9FB21C651E98DF25)

_IPC = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a batch that go to one block, compressed together for the shuffle."""
    for batch in batches:
        block = batch.column("block").to_numpy()
        rows = batch.select(["doc_id", "text", "train"])
        blocks, parts = np.unique(block), []
        for b in blocks.tolist():
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, rows.schema, options=_IPC) as w:
                w.write_batch(rows.take(pa.array(np.flatnonzero(block == b))))
            parts.append(out.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(parts, pa.binary())], names=["block", "rows"])


def _unpacked(table: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in table.column("rows").to_pylist()])


class Block:
    """Tokens of a block: for each text a start mark, its words in lower case, and an end."""

    def __init__(self, table: pa.Table):
        self.doc_id = table.column("doc_id")
        self.train = table.column("train").to_numpy()
        data, offsets = string_buffers(table.column("text"))
        parts, counts = [], []
        for _, _, d, o in slices(data, offsets):
            w = Words(d, o, lower=True)
            n = np.diff(w.offsets)
            out = np.empty(len(w) + 2 * len(n), np.uint64)
            begin = np.concatenate([[0], np.cumsum(n + 2)[:-1]]).astype(np.int64)
            out[begin] = START
            out[begin + n + 1] = END
            inner = np.ones(len(out), bool)
            inner[begin] = inner[begin + n + 1] = False
            out[inner] = w.hash
            parts.append(out)
            counts.append(n + 2)
        self.tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        first = np.cumsum(self.counts) - self.counts
        self.place = (np.arange(len(self.tokens)) - np.repeat(first, self.counts)).astype(np.int32)
        self.trained = np.repeat(self.train, self.counts)

    def ngrams(self, order: int, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each order: different n-grams as sorted keys, how often each is in training texts here, the last places
        of all n-grams in the order of their keys, and which key each has. A start mark alone is none.

        Keys of one word have 64 bits, others `width`, the rest of their bits being 0."""
        key, left = mix(self.tokens * _M), np.uint64(64 - width)
        for n in range(1, order + 1):
            if n > 1:
                key[1:] = mix(mix(key[:-1]) * _M + self.tokens[1:])
            at = np.flatnonzero(self.place >= max(n - 1, 1))
            k = key[at] if n == 1 else key[at] >> left << left
            way = np.argsort(k)
            at, k = at[way], k[way]
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            first = np.flatnonzero(new)
            own = np.add.reduceat(self.trained[at].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
            yield n, k[first], own, at, np.cumsum(new) - 1


ASK = "shard int, block int, n int, keys binary, own binary"
ANSWER = "shard int, block int, n int, total binary, owned binary, sums array<long>"


def _ask(order: int, width: int, n_shards: int):
    def run(table: pa.Table) -> pa.Table:
        rows: dict[str, list] = defaultdict(list)
        for n, keys, own, _, _ in Block(_unpacked(table)).ngrams(order, width):
            for shard, i, j in by_shard(keys, n_shards):
                rows["shard"].append(shard)
                rows["n"].append(n)
                rows["keys"].append(pack(keys[i:j]))
                rows["own"].append(small(own[i:j]))
        block = [table.column("block")[0].as_py()] * len(rows["n"])
        kinds = {"shard": pa.int32(), "block": pa.int32(), "n": pa.int32(), "keys": pa.binary(), "own": pa.binary()}
        return pa.table({c: pa.array(block if c == "block" else rows[c], k) for c, k in kinds.items()})

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Add up the counts of a shard's n-grams over all blocks; answer each block for its own keys.

    Of the blocks that hold an n-gram, one owns it, so that different ones can be counted."""
    out = []
    for n in sorted(set(table.column("n").to_pylist())):
        part = table.filter(pc.equal(table.column("n"), n))
        keys = [unpack(k) for k in part.column("keys").to_pylist()]
        own = np.concatenate([large(x) for x in part.column("own").to_pylist()])
        _, where, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        total = np.bincount(inverse, weights=own).astype(np.int64)[inverse]
        owned = np.zeros(len(inverse), bool)
        owned[where] = True
        ends = np.cumsum([len(k) for k in keys])
        spans = [(e - len(k), e) for e, k in zip(ends, keys, strict=True)]
        part = part.select(["shard", "block", "n"])
        part = part.append_column("total", pa.array([small(total[i:j]) for i, j in spans], pa.binary()))
        part = part.append_column("owned", pa.array([bits(owned[i:j]) if n == 1 else None for i, j in spans], pa.binary()))
        out.append(part.append_column("sums", pa.nulls(len(spans), pa.list_(pa.int64()))))
    return pa.concat_tables(out)


def _bucket(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 0)


def _told(b: Block, answers: pa.Table, order: int, width: int) -> tuple[list[np.ndarray], int]:
    """By order: the training counts of the n-grams that end at each place; and how many different training words
    the block owns."""
    rows = sorted(answers.select(["n", "shard", "total", "owned"]).to_pylist(), key=lambda r: (r["n"], r["shard"]))
    out, kinds = [], 0
    for n, _, _, at, group in b.ngrams(order, width):
        parts = [large(r["total"]) for r in rows if r["n"] == n]
        total = np.concatenate([np.zeros(0, np.int64), *parts])
        if n == 1:
            owned = [flags(r["owned"], len(x)) for r, x in zip(rows, parts, strict=False)]  # order 1 comes first
            kinds = int((np.concatenate([np.zeros(0, bool), *owned]) & (total > 0)).sum())
        x = np.zeros(len(b.tokens), np.int64)
        x[at] = total[group]
        out.append(x)
    return out, kinds


def _sums(order: int, width: int):
    """What a block adds to the sums over all: training texts, tokens, different words, places of words seen once and
    of those seen twice; then for each order from 2, by bucket of the context's count, places of n-grams seen once
    and all. Places behind a start mark, whose count is known only after this step, have a bucket of their own."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"sums": pa.array([], pa.list_(pa.int64()))})
        b = Block(_unpacked(table))
        counts, kinds = _told(b, answers, order, width)
        words = counts[0][b.trained & (b.place > 0)]
        sums = [int(b.train.sum()), len(words), kinds, int((words == 1).sum()), int((words == 2).sum())]
        for n in range(2, order + 1):
            at = np.flatnonzero((b.place >= n - 1) & b.trained)
            bucket = np.where((n == 2) & (b.place[at] == 1), BUCKETS - 1, _bucket(counts[n - 2][at - 1]))
            sums += np.bincount(bucket, weights=counts[n - 1][at] == 1, minlength=BUCKETS).astype(np.int64).tolist()
            sums += np.bincount(bucket, minlength=BUCKETS).tolist()
        return pa.table({"sums": pa.array([sums], pa.list_(pa.int64()))})

    return run


class Automaton:
    """The smoothed weights of states' arcs and failure arcs, from the sums over all training texts."""

    def __init__(self, sums: np.ndarray, order: int):
        self.order = order
        self.texts, self.tokens, self.kinds, once, twice = (int(x) for x in sums[:5])
        self.cut = min(max(once / max(once + twice, 1), 0.1), 0.95)  # twice holds the places of words seen twice
        self.left: list[np.ndarray] = []
        for n in range(2, order + 1):
            s = sums[5 + (n - 2) * 2 * BUCKETS :][: 2 * BUCKETS].reshape(2, BUCKETS).copy()
            start = int(_bucket(np.array([self.texts]))[0])
            s[:, start] += s[:, BUCKETS - 1]
            self.left.append(np.clip((s[0] + 1) / (s[1] + 2), 0.02, 0.999))

    def weights(self, counts: list[np.ndarray], first: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """At each place, by order: log10 of the arc for its token (order 1: or of an unknown word), and of the
        failure arc of the state before it. `counts`: as _told gives them, `first`: places of start marks."""
        c = counts[0]
        unknown = self.cut * self.kinds / self.tokens if self.tokens else 1.0
        p = np.where(c > 0, (c - self.cut) / max(self.tokens, 1), unknown)
        arcs, fails = [np.log10(p)], [np.zeros(len(c))]
        for n in range(2, self.order + 1):
            before = np.zeros(len(c), np.int64)
            before[1:] = counts[n - 2][:-1]
            if n == 2:
                before[first + 1] = self.texts
            left = np.where(before > 0, self.left[n - 2][_bucket(before)], 1.0)
            p = (1 - left) * counts[n - 1] / np.maximum(before, 1) + left * p
            arcs.append(np.log10(p))
            fails.append(np.log10(left))
        return arcs, fails

    def read(self, counts: list[np.ndarray], first: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log10 of each text's probability. A state is named by its number of words, the last ones read."""
        arcs, fails = self.weights(counts, first)
        size = ends - first - 1  # tokens after the start mark
        pieces = -(-size // SEGMENT)
        text = np.repeat(np.arange(len(size)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = first[text] + 1 + nth * SEGMENT
        end = np.minimum(at + SEGMENT, ends[text])
        state = np.zeros(len(at), np.int64)
        for n in range(1, self.order):  # the state that the words before a piece lead to
            state[counts[n - 1][at - 1] > 0] = n
        state[nth == 0] = min(1, self.order - 1) if self.texts else 0
        total = np.zeros(len(at))
        while len(at):
            n = state + 1
            said = np.zeros(len(at))
            for k in range(self.order, 1, -1):  # failure arcs, down to a state with an arc for the token
                stuck = (n == k) & (counts[k - 1][at] == 0)
                said[stuck] += fails[k - 1][at[stuck]]
                n[stuck] -= 1
            for k in range(1, self.order + 1):
                here = n == k
                said[here] += arcs[k - 1][at[here]]
            state = np.where(counts[0][at] > 0, np.minimum(n, self.order - 1), 0)
            total[: len(at)] += said
            at = at + 1
            on = at < end
            if not on.all():  # those that go on move to the front
                keep = np.concatenate([np.flatnonzero(on), np.flatnonzero(~on)])
                total[: len(at)], text[: len(at)] = total[: len(at)][keep], text[: len(at)][keep]
                at, end, state = at[on], end[on], state[on]
        return np.bincount(text, weights=total, minlength=len(size))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(order: int, width: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in SCORES.split(", ")]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not table.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        n = answers.column("n").to_pylist()
        a = Automaton(np.array(answers.column("sums")[n.index(0)].as_py(), np.int64), order)
        b = Block(_unpacked(table))
        counts, _ = _told(b, answers.filter(pc.greater(answers.column("n"), 0)), order, width)
        ends = np.cumsum(b.counts)
        known, base, score = [], [], []
        i = 0
        while i < len(ends):  # texts of a bounded number of places, or one longer text
            begin = ends[i] - b.counts[i]
            j = max(i + 1, int(np.searchsorted(ends, begin + (1 << 18), side="right")))
            part = [x[begin : ends[j - 1]] for x in counts]
            last = ends[i:j] - begin
            first = last - b.counts[i:j]
            c = np.delete(part[0], first)
            text = np.repeat(np.arange(j - i), b.counts[i:j] - 1)
            known.append(np.bincount(text, weights=c > 0, minlength=j - i).astype(np.int64))
            base.append(np.bincount(text, weights=np.log10((c + 0.5) / (a.tokens + 0.5 * (a.kinds + 1))), minlength=j - i))
            score.append(a.read(part, first, last))
            i = j
        columns = [b.doc_id, ~b.train, b.counts - 1, np.concatenate(known), np.full(len(ends), a.tokens), np.concatenate(base), np.concatenate(score)]
        return pa.table([x if isinstance(x, pa.ChunkedArray) else pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)

    return run


def lm_scores(docs: DataFrame, train: str = "pmod(crc32(cast(cast(doc_id as string) as binary)), 5) <> 1", order: int = 3, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of every row.

    `train` is SQL for the rows to learn from; a null id counts as one of them. Null and empty texts
    are one end token. Repeated rows count and score each. Without training texts every token is as
    likely as any other: scores are 0. An empty table gives an empty result; other columns are not
    read."""
    base = texts(docs).withColumn("train", F.coalesce(F.expr(train), F.lit(True)))
    n_blocks = block_count(base, block_bytes)
    packed = base.withColumn("block", block_of(n_blocks)).select("doc_id", "text", "train", "block").mapInArrow(_packed, "block int, rows binary")
    dealt, words = packed.groupBy("block"), n_blocks * block_bytes / 6
    width = min(64, math.ceil(math.log2(words * order)) + SPARE_BITS)
    asked = dealt.applyInArrow(_ask(order, width, max(1, math.ceil(words * (order - 1) / SHARD_KEYS))), ASK)
    answers = asked.groupBy("shard").applyInArrow(_answer, ANSWER)
    added = dealt.cogroup(answers.groupBy("block")).applyInArrow(_sums(order, width), "sums array<long>")
    added = added.select(F.posexplode("sums").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x"))
    one = added.agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("all"))  # of a fixed number of rows
    runs = one.select(F.col("all.x").alias("sums"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks // RUN))).alias("run")).repartition("run")
    for_all = runs.select("sums", F.lit(0).alias("n"), F.explode(F.expr(f"sequence(run * {RUN}, run * {RUN} + {RUN - 1})")).alias("block")).where(F.col("block") < n_blocks)
    told = answers.unionByName(for_all, allowMissingColumns=True)
    return dealt.cogroup(told.groupBy("block")).applyInArrow(_score(order, width), SCORES)
