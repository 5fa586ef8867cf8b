"""Text helpers for Arrow batches: bounded chunks of UTF-8 bytes, words and pre-tokens as offset arrays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 60_000
LETTER, NUMBER, OTHER, SPACE, EDGE = range(5)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]: at[-1]], at - at[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first row, end row, joined bytes, offsets) of runs of rows with about ``most`` bytes; texts are never cut."""
    raw, at = utf8(column)
    first, n = 0, len(at) - 1
    while first < n:
        end = int(np.searchsorted(at, at[first] + most, "right")) - 1
        end = min(max(end, first + 1), n, first + CHUNK_ROWS)
        yield first, end, raw[at[first]: at[end]].tobytes(), at[first: end + 1] - at[first]
        first = end


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point by Unicode property: letter, number, white space or other."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for run in regex.finditer(name, every):
            for c in run.group() if kind == SPACE else (run.group()[0],):
                table[ord(c)] = kind
            if kind != SPACE:
                low, high = ord(run.group()[0]), ord(run.group()[-1])
                if low < 0xD800 <= high:
                    table[low:0xD800] = kind
                    low = 0xE000
                table[low: high + 1] = kind
    return table


def pre_tokens(joined: bytes, offsets: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each pre-token; starts and ends are byte positions in ``joined``.

    ``spaced``: the split of byte-level BPE, where a run of letters, of numbers or of other characters
    takes one space before it and white space makes tokens of its own. Otherwise white space is
    dropped, runs of letters and of others stand alone, and each number is a token. In both, an
    apostrophe that starts a token takes the endings s, t, re, ve, m, ll and d with it.
    """
    rows = len(offsets) - 1
    # one edge byte behind each row keeps rows apart
    data = np.frombuffer(joined, np.uint8)
    buf = np.zeros(len(data) + rows + 3, np.uint8)
    place = np.ones(len(buf), bool)
    edge = offsets[1:] + np.arange(rows)
    place[edge] = False
    place[len(data) + rows:] = False
    buf[place] = data
    buf = buf[: len(data) + rows]
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    cp = buf if len(lead) == len(buf) else np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
    cls = classes()[cp]
    at_edge = np.searchsorted(lead, edge)
    cls[at_edge] = EDGE
    prev = np.empty_like(cls)
    prev[0], prev[1:] = EDGE, cls[:-1]
    start = cls != prev
    if spaced:
        nxt = np.empty_like(cls)
        nxt[-1], nxt[:-1] = EDGE, cls[1:]
        joins = np.zeros(len(cls), bool)
        joins[1:] = (cp[:-1] == 0x20) & (prev[1:] == SPACE)
        space = cls == SPACE
        start = np.where(space, start | ((nxt != SPACE) & (nxt != EDGE)), start & ~joins)
    else:
        start |= cls == NUMBER
    start |= cls == EDGE
    marks = np.flatnonzero((cp == 0x27) & start & (cls != EDGE))
    if len(marks):
        tail = np.concatenate([cp, np.zeros(3, cp.dtype)])
        c1, c2 = tail[marks + 1], tail[marks + 2]
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = ((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l"))
        start[marks[one | two] + 1] = False
        start[marks[one] + 2] = True
        start[marks[two] + 3] = True
    cuts = np.flatnonzero(start)
    kind = cls[cuts]
    row = np.cumsum(kind == EDGE)
    keep = kind != EDGE if spaced else (kind != EDGE) & (kind != SPACE)
    keep[-1] = False  # the last cut is the edge behind the last row
    at = lead[cuts]
    index = np.flatnonzero(keep)
    row = row[index]
    return at[index] - row, at[index + 1] - row, row


def packed(joined: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 16 bytes of each slice as two integers, zero behind its end."""
    buf = joined + bytes(16)
    word = np.ndarray((len(buf) - 7,), "<u8", buffer=buf, strides=(1,))
    size = end - start
    low = word[start] & _MASKS[np.minimum(size, 8)]
    high = word[np.minimum(start + 8, len(word) - 1)] & _MASKS[np.clip(size - 8, 0, 8)]
    return low, high


def mixed(low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of packed slices."""
    h = low * np.uint64(0x9E3779B97F4A7C15) ^ (high + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def distinct(joined: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each slice, index of one slice of each code): equal bytes share a code."""
    size = end - start
    low, high = packed(joined, start, end)
    short = size <= 16
    key = mixed(low, high, size)
    for i in np.flatnonzero(~short):
        key[i] = hash(joined[start[i]: end[i]]) & 0xFFFFFFFFFFFFFFFF
    code, _ = pd.factorize(key)
    first = np.full(code.max() + 1 if len(code) else 0, -1, np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    lead = first[code]
    same = (low == low[lead]) & (high == high[lead]) & (size == size[lead])
    for i in np.flatnonzero(~short & same & (lead != np.arange(len(code)))):
        same[i] = joined[start[i]: end[i]] == joined[start[lead[i]]: end[lead[i]]]
    if not same.all():  # two slices share a hash: take the bytes themselves
        seen: dict[bytes, int] = {}
        code = np.array([seen.setdefault(joined[a:b], len(seen)) for a, b in zip(start, end)], np.int64)
        first = np.unique(code, return_index=True)[1]
    return code, first


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ... (count[0] values), then those of begin[1], and so on."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(begin - (ends - count), count)
