"""Exact token counts at every prefix of a text, for a byte-level BPE vocabulary file.

The table for one piece of text (what the pre-tokeniser never merges across) comes from a dynamic
programme over its byte prefixes: the encoding of a prefix ends in exactly one token t, namely the
one for which the encoding of the rest ends in a token u such that u and t stay apart when merged
in order of rank. So last[i] = t and count[i] = count[i - len(t)] + 1, and no prefix is encoded
again. Counts of pieces add up, so the count at any prefix of a text is a running sum over the
pieces before it plus one table entry.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import texts

#: Characters with the White_Space property, and the pieces of a byte-level vocabulary.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
CHUNKS = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+")
#: Pieces whose counts a worker keeps; then it starts anew, so its memory does not grow with the input.
MEMO = 600_000


def _byte_names() -> dict[str, int]:
    """The printable stand-ins that vocabulary files use for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in set(shown)):
        names[chr(256 + k)] = b
    return names


class PrefixCounter(dict):
    """Maps a chunk (a run without inner white space) to its token count; see count_at for prefixes."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"{path} is not a byte-level BPE vocabulary without prefix space")
        names = _byte_names()
        plain = lambda s: bytes(names[c] for c in s)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.ids = {plain(s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        #: Every tail of a token; -1 for one that is no token itself. A walk leftwards stops at the first string outside.
        self.tails: dict[bytes, int] = {}
        for b, i in self.ids.items():
            for k in range(1, len(b)):
                self.tails.setdefault(b[k:], -1)
            self.tails[b] = i
        self.merged: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = (plain(x) for x in (m.split(" ") if isinstance(m, str) else m))
            both = self.ids[a + b]
            self.merged[self.ids[a], self.ids[b]] = both
            if both not in self.rank:
                self.rank[both], self.parts[both] = r, (self.ids[a], self.ids[b])
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.special_strings = special
        self._pieces: dict[str, int] = {}
        self._apart: dict[int, bool] = {}
        self._self: dict[int, bool] = {}

    def apart(self, u: int, t: int) -> bool:
        """Whether merging the bytes of u followed by those of t ends in just u and t."""
        found = self._apart.get(u << 20 | t)
        if found is None:
            if len(self._apart) > MEMO:
                self._apart.clear()
            found = self._apart[u << 20 | t] = self._undo(u, t, float("inf"), -1)
        return found

    def whole(self, t: int) -> bool:
        """Whether the bytes of t are encoded as t alone."""
        if t not in self.parts:
            return True
        found = self._self.get(t)
        if found is None:
            a, b = self.parts[t]
            found = self._self[t] = self.whole(a) and self.whole(b) and self._undo(a, b, self.rank[t], t)
        return found

    def _undo(self, a: int, b: int, bound: float, wanted: int) -> bool:
        """Whether a and b, whose merges below rank `bound` all happen, meet no other merge at their border.

        The merge done last is undone first. A pair that meets at the border would have been merged
        before that step exactly if its rank is lower; of two merges of one rank the left one is first."""
        rank, merged, parts = self.rank, self.merged, self.parts
        while True:
            m = merged.get((a, b))
            if m is not None and m != wanted and rank[m] < bound:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                bound, a = ra, parts[a][1]
            else:
                bound, b = rb + 1, parts[b][0]

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Token counts of piece[:0], piece[:1], ..., piece."""
        last, count, tails, apart = [-1], [0], self.tails, self._apart
        for i in range(1, len(piece) + 1):
            ends, j = [], i - 1
            while j >= 0:
                t = tails.get(piece[j:i])
                if t is None:
                    break
                if t >= 0:
                    ends.append((j, t))
                j -= 1
            for j, t in reversed(ends):
                if j:
                    found = apart.get(last[j] << 20 | t)
                    if found or (found is None and self.apart(last[j], t)):
                        break
                elif self.whole(t):
                    break
            last.append(t)
            count.append(count[j] + 1)
        return count

    def __missing__(self, chunk: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        if chunk.isalpha() or (chunk[0] == " " and chunk[1:].isalpha()):
            n = self.prefix_counts(chunk.encode())[-1]
        else:
            n = sum(map(self._piece, PIECES.findall(chunk)))
        self[chunk] = n
        return n

    def _piece(self, piece: str) -> int:
        n = self._pieces.get(piece) or self.get(piece)
        if n is None:
            if len(self._pieces) >= MEMO:
                self._pieces.clear()
            n = self._pieces[piece] = self.prefix_counts(piece.encode())[-1]
        return n

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """Runs of ordinary text, and special strings (one token each)."""
        if self.special is None or not any(s in text for s in self.special_strings):
            yield text, False
            return
        at = 0
        for m in self.special.finditer(text):
            yield text[at : m.start()], False
            yield m.group(), True
            at = m.end()
        yield text[at:], False

    def chunks(self, text: str) -> tuple[list[str], list[int]]:
        pieces: list[str] = []
        counts: list[int] = []
        for part, special in self.segments(text):
            if special:
                pieces.append(part)
                counts.append(1)
            else:
                found = CHUNKS.findall(part)
                pieces += found
                counts += map(self.__getitem__, found)
        return pieces, counts

    def total(self, text: str) -> int:
        return sum(self.chunks(text)[1])

    def count_at(self, text: str, n_chars: int) -> int:
        """Tokens of text[:n_chars]: the sum before the chunk that the cut is in, and one table entry.

        White space at the cut is one piece of its own there, though not in the whole text."""
        head = text[:n_chars]
        if self.special is not None and any(m.start() < len(head) < m.end() for m in self.special.finditer(text)):
            return self.total(head)
        pieces, counts = self.chunks(text)
        at, done, solid = 0, 0, len(head.rstrip(WHITE))
        for piece, n in zip(pieces, counts, strict=True):
            if at + len(piece) > solid:
                break
            at, done = at + len(piece), done + n
        tail = head[at:]
        return done + (self.total(tail) if tail else 0)

    def cut(self, text: str, limit: int, pieces: list[str], counts: list[int]) -> int:
        """Code points of the longest prefix of whole chunks and table entries with at most `limit` tokens."""
        sums = list(accumulate(counts))
        k = bisect_right(sums, limit)
        if k == len(pieces):
            return len(text)
        at, left = sum(map(len, pieces[:k])), limit - (sums[k - 1] if k else 0)
        if self.special is not None and self.special.fullmatch(pieces[k]):
            return at
        for p in PIECES.findall(pieces[k]):
            table = self.prefix_counts(p.encode())
            if table[-1] > left:
                return at + max((c for c in range(len(p)) if table[len(p[:c].encode())] <= left), default=0)
            at, left = at + len(p), left - table[-1]
        return at


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, cut_chars (code points within the token budget) per row.

    A null text counts as empty: no tokens. Repeated rows and null ids give a row each; other
    columns are not read. `vocabulary` is the file's path on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for batch in batches:
            n_bytes, n_tokens, over, cut = [], [], [], []
            for text in batch.column("text").to_pylist():
                pieces, counts = c.chunks(text)
                n = sum(counts)
                n_bytes.append(len(text.encode()))
                n_tokens.append(n)
                over.append(n > limit)
                cut.append(c.cut(text, limit, pieces, counts) if n > limit else len(text))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(over, pa.bool_()), pa.array(cut, pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_chars"])

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_chars long")
