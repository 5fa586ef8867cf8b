"""Windows of text in bounded memory: long texts are taken in parts that end at a separator."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .text import utf8

_ODD = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_table(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


def windows(column: pa.Array, cuts: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, bytes, np.ndarray]]:
    """(row of each part, joined bytes, offsets of the parts): runs of parts with about ``most`` bytes.

    A text of up to ``most`` bytes is one part. A longer one is cut behind bytes that ``cuts`` marks; a
    stretch without such a byte is never cut, so memory grows with the longest stretch, not the text.
    A null is an empty text. Every row has a part.
    """
    raw, at = utf8(column)
    rows: list[int] = []
    ends: list[int] = []
    first = int(at[0])

    def full():
        edges = np.array([first, *ends], np.int64)
        return np.array(rows, np.int64), raw[first: ends[-1]].tobytes(), edges - first

    for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        while True:
            end = b
            if b - a > most:
                places = np.flatnonzero(cuts[raw[a: a + most]])
                if len(places):
                    end = a + int(places[-1]) + 1
                else:
                    end, step = a + most, most
                    while end < b:
                        places = np.flatnonzero(cuts[raw[end: min(end + step, b)]])
                        if len(places):
                            end += int(places[0]) + 1
                            break
                        end = min(end + step, b)
            if rows and (end - first > most or len(rows) >= 60_000):
                yield full()
                rows, ends, first = [], [], a
            rows.append(row)
            ends.append(end)
            a = end
            if a >= b:
                break
    if rows:
        yield full()


def spans(buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, part) of the runs of bytes that ``separators`` does not mark; no run crosses a part."""
    if not len(buf):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    apart = separators[buf]
    begins, stops = ~apart, ~apart
    begins[1:] &= apart[:-1]
    stops[:-1] &= apart[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(buf))]
    begins[inner] = ~apart[inner]
    stops[inner - 1] = ~apart[inner - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(stops) + 1, np.searchsorted(offsets, start, "right") - 1


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2^64, grown as needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            steps = np.full(n + n // 4, _ODD, np.uint64)
            steps[0] = 1
            cls.up = np.cumprod(steps, dtype=np.uint64)
            steps[1:] = pow(_ODD, -1, 1 << 64)
            cls.down = np.cumprod(steps, dtype=np.uint64)
        return cls.up[:n], cls.down[:n]


def scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice, alike in every process; the case of A-Z does not count."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _Powers.of(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((_LOWER[buf].astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    return scrambled((total[end] - total[start]) * down[start])


def column_hashes(column: pa.Array) -> np.ndarray:
    """The same hash of each value of a string column."""
    raw, at = utf8(column)
    return hashes(raw, at[:-1], at[1:])
