"""Messages between blocks of documents and shards of a key space: sorted 64-bit keys and small counts as bytes.

A block asks each shard, a range of the key space, about the keys that it has there, once each. Ranges
without keys make no message, so there are never more messages than keys, however many blocks and
shards there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_CODEC = pa.Codec("zstd", compression_level=3)


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences of as many bytes as the largest one needs, without bits that are 0 in all."""
    if not len(keys):
        return b""
    every = int(np.bitwise_or.reduce(keys))
    unused = (every & -every).bit_length() - 1 if every else 0
    gaps = np.diff(keys, prepend=keys[:1]) >> np.uint64(unused)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    body = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return keys[:1].tobytes() + bytes([unused, width]) + np.ascontiguousarray(body).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    unused, width = blob[8], blob[9]
    raw = np.frombuffer(blob, np.uint8, offset=10).reshape(-1, width)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :width] = raw
    gaps = np.cumsum(full.reshape(-1).view("<u8"), dtype=np.uint64)
    return np.frombuffer(blob, "<u8", count=1)[0] + (gaps << np.uint64(unused))


def small(x: np.ndarray) -> bytes:
    """Counts, most of them small: a byte each, those of 255 and more behind."""
    big = x >= 255
    body = np.where(big, 255, x).astype(np.uint8).tobytes() + x[big].astype("<i8").tobytes()
    return np.array([len(x), len(body)], "<i8").tobytes() + _CODEC.compress(body, asbytes=True)


def large(blob: bytes) -> np.ndarray:
    n, size = np.frombuffer(blob, "<i8", count=2).tolist()
    raw = _CODEC.decompress(blob[16:], decompressed_size=size, asbytes=True)
    x = np.frombuffer(raw, np.uint8, count=n).astype(np.int64)
    x[x == 255] = np.frombuffer(raw, "<i8", offset=n)
    return x


def bits(x: np.ndarray) -> bytes:
    """Truth values, eight to a byte; `flags` reads them."""
    return np.packbits(x).tobytes()


def flags(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def edges(n_shards: int) -> np.ndarray:
    return np.array([(k << 64) // n_shards for k in range(1, n_shards)], np.uint64)


def by_shard(keys: np.ndarray, n_shards: int) -> Iterator[tuple[int, int, int]]:
    """(shard, begin, end) of the sorted keys in each shard that has some."""
    if len(keys):
        cuts = np.concatenate([[0], np.searchsorted(keys, edges(n_shards)), [len(keys)]])
        for shard in np.flatnonzero(np.diff(cuts)).tolist():
            yield shard, int(cuts[shard]), int(cuts[shard + 1])
