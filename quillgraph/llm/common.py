"""Shared helpers: reading tables, whole-text Arrow access and vectorised word hashing."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one block (a unit of work of the blocked operators) holds on average.
BLOCK_BYTES = 8 << 20
#: Bytes of text hashed at once inside a worker; one longer document is hashed alone.
SLICE_BYTES = 1 << 20

_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and text with null read as empty; other columns only if named."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def _shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only in local mode, where all executors see it."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    folder = known.get() if not known.isEmpty() else context.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quillgraph-checkpoints-"))
        folder = context._jsc.sc().getCheckpointDir().get()
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage by a table written to the shared folder, whose true size also plans the joins that follow."""
    path = f"{_shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def block_count(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks of about block_bytes of text; grows with the input, so a block does not."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, math.ceil(total / block_bytes))


def block_of(n_blocks: int) -> Column:
    """The block of a row with doc_id and text, so that rows without an id are dealt too."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int")


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying the text; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # combine_chunks of several chunks may stay chunked
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=4)
def _byte_table(seed: int, lower: bool) -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    if lower:
        t[65:91] = t[97:123]
    t[list(_SPACES)] = 0
    return t


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
        inverse = pow(base, -1, 1 << 64)
        made = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        have = (made[0], made[1])
        if n <= SLICE_BYTES + (SLICE_BYTES >> 2):
            _POWERS[base] = have
    return have


class Words:
    """The words of a run of texts: two independent 64-bit hashes, byte spans and per-text offsets."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, wide: bool = False):
        n = len(data)
        space = np.zeros(256, bool)
        space[list(_SPACES)] = True
        word = ~space[data]
        start = word.copy()
        start[1:] &= ~word[:-1]
        begins = offsets[:-1][offsets[:-1] < n]
        start[begins] |= word[begins]
        self.starts = np.flatnonzero(start)
        end = word.copy()
        end[:-1] &= ~word[1:] | start[1:]
        self.ends = np.flatnonzero(end) + 1
        self.offsets = np.searchsorted(self.starts, offsets)
        self.hash = self._hash(data, 0x5DEECE66D1CE4E5B, 0x9E3779B97F4A7C15 | 1, lower)
        self.hash2 = self._hash(data, 0x2545F4914F6CDD1D, 0xD1342543DE82EF95 | 1, lower) if wide else None

    def _hash(self, data: np.ndarray, seed: int, base: int, lower: bool) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        power, inverse = _powers(base, len(data))
        x = _byte_table(seed & 0x7FFFFFFFFFFFFFFF, lower)[data]
        x *= power[: len(data)]
        h = np.add.reduceat(x, self.starts)
        h *= inverse[self.starts]
        return mix(h ^ ((self.ends - self.starts).astype(np.uint64) << np.uint64(48)))

    def __len__(self) -> int:
        return len(self.starts)


def windows(h: np.ndarray, k: int, base: int = 0xC6A4A7935BD1E995) -> np.ndarray:
    """Hashes of all k consecutive entries, by doubling: 2k from k in one step."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    m = (1 << 64) - 1
    out, done, have, length = None, 0, h, 1
    bits = k
    while bits:
        if bits & 1:
            if out is None:
                out, done = have, length
            else:
                size = len(h) - done - length + 1
                out = out[:size] * np.uint64(pow(base, length, 1 << 64) & m) + have[done : done + size]
                done += length
        bits >>= 1
        if bits:
            size = len(h) - 2 * length + 1
            have = have[:size] * np.uint64(pow(base, length, 1 << 64) & m) + have[length : length + size]
            length *= 2
    return mix(out[: len(h) - k + 1])


def slices(data: np.ndarray, offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, bytes, offsets) for runs of texts of at most `most` bytes, or one longer text."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_slices(column: pa.Array | pa.ChunkedArray, lower: bool = False, wide: bool = False) -> Iterator[tuple[int, int, Words, np.ndarray, np.ndarray]]:
    data, offsets = string_buffers(column)
    for i, j, d, o in slices(data, offsets):
        yield i, j, Words(d, o, lower, wide), d, o


def as_long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))
