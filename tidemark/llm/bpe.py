"""Byte-level BPE encoding and decoding with a two-tier lookup of pre-tokens.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is itself a token resolves with
one probe, for all distinct pre-tokens of a chunk at once. Tier two merges the rest with a heap over
linked bytes, lowest rank first; merged pre-tokens are remembered in a bounded table per worker.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import chunks, distinct, mixed, packed, pre_tokens, spread

#: Pre-tokens in each of the two generations of a worker's memory.
REMEMBERED = 120_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with one base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@dataclass(frozen=True)
class PerfectHash:
    """n keys of at most 16 bytes in n slots: a bucket's displacement moves its keys to free slots."""

    low: np.ndarray
    high: np.ndarray
    size: np.ndarray
    value: np.ndarray
    shift: np.ndarray  # by bucket: a displacement, or -1 - slot for a bucket of one key

    @staticmethod
    def build(entries: dict[bytes, int]) -> PerfectHash:
        keys = list(entries)
        n = len(keys)
        size = np.array([len(k) for k in keys], np.int64)
        ends = np.cumsum(size)
        starts = ends - size
        low, high = packed(b"".join(keys), starts, ends)
        h = mixed(low, high, size)
        if len(np.unique(h)) < n:
            raise ValueError("two vocabulary entries share a 64-bit hash")
        buckets = max(1, n // 2)
        shift = np.zeros(buckets, np.int64)
        slot = np.full(n, -1, np.int64)
        of = h % np.uint64(buckets)
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(buckets + 1).astype(np.uint64))
        free = np.ones(n, bool)
        singles = []
        for b in np.argsort(-np.diff(cuts), kind="stable").tolist():
            own = order[cuts[b]: cuts[b + 1]]
            if len(own) <= 1:
                singles += [(b, own[0])] if len(own) else []
                continue
            tries = np.arange(64)
            while True:
                at = np.sort(PerfectHash._slot(h[own][None, :], tries[:, None], n), axis=1)
                good = np.flatnonzero(free[at].all(1) & (np.diff(at, axis=1) > 0).all(1))
                if len(good):
                    break
                tries = tries + 64
            shift[b] = tries[good[0]]
            slot[own] = PerfectHash._slot(h[own], shift[b], n)
            free[slot[own]] = False
        for (b, key), at in zip(singles, np.flatnonzero(free), strict=True):
            shift[b], slot[key] = -1 - at, at
        back = np.empty(n, np.int64)
        back[slot] = np.arange(n)
        values = np.array([entries[k] for k in keys], np.int64)
        return PerfectHash(low[back], high[back], size[back], values[back], shift)

    @staticmethod
    def _slot(h: np.ndarray, d, n: int) -> np.ndarray:
        d = np.asarray(d).astype(np.uint64)
        x = (h >> np.uint64(7)) + d * ((h >> np.uint64(33)) | np.uint64(1)) + d * d
        return (x % np.uint64(max(n, 1))).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The value of each packed key, -1 where it is no entry; keys over 16 bytes are never entries."""
        if not len(self.value) or not len(low):
            return np.full(len(low), -1, np.int64)
        h = mixed(low, high, size)
        d = self.shift[(h % np.uint64(len(self.shift))).astype(np.int64)]
        at = np.where(d < 0, -1 - d, self._slot(h, np.maximum(d, 0), len(self.value)))
        hit = (self.low[at] == low) & (self.high[at] == high) & (self.size[at] == size)
        return np.where(hit, self.value[at], -1)


class Merges:
    """Merges of one pre-token at a time, by rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte = [ranks[bytes([b])] for b in range(256)] if ranks else []
        self.pairs = {}  # two ids, as one integer, to the id of their bytes together
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = rank

    def __call__(self, piece: bytes) -> list[int]:
        """Ids of a pre-token: its bytes are linked, and a heap gives the adjacent pair of lowest rank, leftmost first."""
        n, byte, pair = len(piece), self.byte, self.pairs.get
        ids = [byte[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [pair(a << 32 | b, -1) for a, b in zip(ids, ids[1:])]  # of the pair that starts here, now
        rank.append(-1)
        heap = [r << 32 | i for i, r in enumerate(rank) if r >= 0]
        heapify(heap)
        while heap:
            top = heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            if rank[i] != r:  # merged otherwise since
                continue
            gone = after[i]
            ids[i], rank[gone] = r, -1
            k = after[i] = after[gone]
            if k < n:
                before[k] = i
                q = rank[i] = pair(r << 32 | ids[k], -1)
                if q >= 0:
                    heappush(heap, q << 32 | i)
            else:
                rank[i] = -1
            p = before[i]
            if p >= 0:
                q = rank[p] = pair(ids[p] << 32 | r, -1)
                if q >= 0:
                    heappush(heap, q << 32 | p)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.short = PerfectHash.build({k: v for k, v in self.ranks.items() if len(k) <= 16})
        self.merge = Merges(self.ranks)
        self.memory: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        most = max(self.ranks.values(), default=-1) + 1
        by_id = [b""] * most
        for token, rank in self.ranks.items():
            by_id[rank] = token
        self.length = np.array([len(t) for t in by_id], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)

    def merged(self, piece: bytes) -> bytes:
        """Ids of a pre-token that tier one does not hold, from memory or from the heap."""
        found = self.memory.get(piece)
        if found is None:
            found = self.older.get(piece)
            if found is None:
                rank = self.ranks.get(piece) if len(piece) > 16 else None
                ids = self.merge(piece) if rank is None else [rank]
                found = array("I", ids).tobytes()
            if len(self.memory) >= REMEMBERED:
                self.memory, self.older = {}, self.memory
            if len(piece) <= 64:
                self.memory[piece] = found
        return found

    def encode(self, joined: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows behind one another, and the number of ids of each row."""
        start, end, row = pre_tokens(joined, offsets, spaced=True)
        rows = len(offsets) - 1
        if not len(start):
            return np.zeros(0, "<u4"), np.zeros(rows, np.int64)
        code, first = distinct(joined, start, end)
        a, b = start[first], end[first]
        low, high = packed(joined, a, b)
        whole = self.short.find(low, high, b - a)
        whole[b - a > 16] = -1
        count = np.ones(len(first), np.int64)
        at = np.zeros(len(first), np.int64)
        misses = np.flatnonzero(whole < 0)
        found = [self.merged(joined[x:y]) for x, y in zip(a[misses].tolist(), b[misses].tolist(), strict=True)]
        count[misses] = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at[misses] = np.cumsum(count[misses]) - count[misses]
        hits = np.flatnonzero(whole >= 0)
        at[hits] = count[misses].sum() + np.arange(len(hits))
        table = np.concatenate([np.frombuffer(b"".join(found), np.uint32), whole[hits].astype(np.uint32)])
        per = count[code]
        return table[spread(at[code], per)].astype("<u4"), np.bincount(row, weights=per, minlength=rows).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows behind one another, and the number of bytes of each row."""
        size = self.length[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        cuts = np.concatenate([[0], np.cumsum(counts)])
        return self.bytes[spread(self.start[ids], size)], np.diff(ends[cuts])


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def binary(data: bytes, counts: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def byte_bpe(docs: DataFrame, ranks_path: str, key: str = "doc_id") -> DataFrame:
    """Encode every whole ``text`` and decode the ids again.

    Returns ``key`` as it is, ``ids`` (binary: the ids as little-endian unsigned 32-bit integers) and
    ``decoded`` (binary: the bytes that the ids stand for, always those of the text). Rows keep their
    partition; nothing is shuffled. A null or empty text gives two empty values; null and repeated keys
    pass through, one row each; other columns are ignored. ``ranks_path`` must be readable on executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path)
        for batch in batches:
            for first, end, joined, offsets in chunks(batch.column(1)):
                ids, counts = own.encode(joined, offsets)
                back, sizes = own.decode(ids, counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), binary(ids.tobytes(), counts * 4), binary(back.tobytes(), sizes)],
                    [key, "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, ids binary, decoded binary")
