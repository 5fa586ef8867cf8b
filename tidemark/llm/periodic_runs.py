"""Periodic runs of words: stretches that repeat one block of words at least four times.

Periods below ``SHORT`` are found by comparing the words with themselves at each lag. Longer ones are found
by minimizers at one scale for each doubling: at scale w, for periods from w to 2w, the smallest of w
consecutive (w / 2)-word groups is marked. Inside a run with such a period the marks repeat at period
distance, so pairs of equal marks w to 2w apart are seeds, which are extended both ways word by word.

Why no run is lost: every group inside a run occurs again, so groups that occur once are never marked,
and a run shows as at least 3.5 w groups in a row that occur again. A group that stood less than w / 4 words
before is not marked either; if that held over a whole period, the period would not be the smallest.
What is marked depends only on the words around it, so it repeats with the run. Equal marks are therefore
w / 4 apart or more, and each has at most seven partners within 2w.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .text import chunks, distinct, spread

#: Periods below it are found by lag scans; the smallest scale. A power of two from 8 on.
SHORT = 16
#: A run holds this many words at least, and its period this many times.
LEAST_WORDS, LEAST_TIMES = 6, 4
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def word_spans(joined: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) in bytes of the words of all rows, and the number of words before each row (and in all)."""
    buf = np.frombuffer(joined, np.uint8)
    if not len(buf):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    space = _SPACE[buf]
    begins, stops = ~space, ~space
    begins[1:] &= space[:-1]
    stops[:-1] &= space[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(buf))]
    begins[inner] = ~space[inner]
    stops[inner - 1] = ~space[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return start, end, np.searchsorted(start, offsets)


def _stretches(mark: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the stretches of true values of length ``least`` or more."""
    edge = np.flatnonzero(np.diff(mark.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    keep = end - start >= least
    return start[keep], end[keep]


def _mixed(name: np.ndarray) -> np.ndarray:
    h = (name.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _again(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which values occur again, their dense codes)."""
    code, uniques = pd.factorize(name)
    live = (np.bincount(code, minlength=len(uniques)) > 1)[code]
    return live, code


def _in_rows(at: np.ndarray, least: int) -> np.ndarray:
    """Which of the ascending positions lie in ``least`` or more consecutive ones."""
    lead = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    size = np.diff(lead, append=len(at))
    return np.repeat(size >= least, size)


def _marked(at: np.ndarray, name: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimizers of all windows of ``width`` groups, sorted by name and position."""
    order = np.lexsort((at, name))
    close = np.zeros(len(at), bool)
    close[1:] = (name[order][1:] == name[order][:-1]) & (np.diff(at[order]) < width // 4)
    bits = np.uint64(max(len(at), 2).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = (_mixed(name) & ~low) | np.arange(len(at), dtype=np.uint64)  # of equal groups the first counts
    least[order[close]] = _NONE
    step = 1
    while step < width and step < len(least):
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    chosen = np.zeros(len(at), bool)
    chosen[(least[least != _NONE] & low).astype(np.int64)] = True
    order = order[chosen[order]]
    return at[order], name[order]


def _reach(x: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The stretch around ``at`` in which all words equal those ``lag`` words on."""
    n, block, end = len(x) - lag, 64, at
    while end < n:
        stop = min(end + block, n)
        odd = np.flatnonzero(x[end:stop] != x[end + lag: stop + lag])
        if len(odd):
            end += int(odd[0])
            break
        end, block = stop, block * 2
    block, start = 64, at
    while start > 0:
        stop = max(start - block, 0)
        odd = np.flatnonzero(x[stop:start] != x[stop + lag: start + lag])
        if len(odd):
            start = stop + int(odd[-1]) + 1
            break
        start, block = stop, block * 2
    return start, end


def _long_runs(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, end, lag) of stretches that repeat at a lag of SHORT or more; multiples of the smallest may come too."""
    at, name, group = np.arange(len(x)), x, 1
    full = np.full(len(x) + 1, -1, np.int64)
    width = SHORT
    while True:
        # from groups of ``group`` words to those of the scale
        while True:
            live, code = _again(name)
            at, name = at[live], code[live]
            keep = _in_rows(at, LEAST_TIMES * width - group)
            at, name = at[keep], name[keep]
            if not len(at):
                return
            if group == width // 2:
                break
            full[:] = -1
            full[at] = name
            then = full[np.minimum(at + group, len(x))]
            pair = then >= 0
            at, name = at[pair], name[pair] * len(full) + then[pair]
            group *= 2
        place, what = _marked(at, name, width)
        seeds = []
        for step in range(1, 8):
            lag = place[step:] - place[:-step]
            ok = (what[step:] == what[:-step]) & (lag >= width) & (lag < 2 * width)
            seeds.append(np.stack([lag[ok], place[:-step][ok]], 1))
        lag, place = np.concatenate(seeds).T
        # three periods of equal words around a seed: one and a half behind it, or as many before it
        ahead, back = np.ones(len(lag), bool), np.ones(len(lag), bool)
        for part in (1, 2, 3, 4, 5):
            for ok, t in ((ahead, place + part * lag // 4), (back, place - part * lag // 4)):
                inside = (t >= 0) & (t + lag < len(x))
                t = np.where(inside, t, 0)
                ok &= inside & (x[t] == x[np.where(inside, t + lag, 0)])
        order = np.lexsort((place, lag))
        order = order[(ahead | back)[order]]
        done = (0, 0)
        for q, i in zip(lag[order].tolist(), place[order].tolist()):
            if q == done[0] and i < done[1]:
                continue
            start, end = _reach(x, i, q)
            done = (q, end)
            if end - start >= (LEAST_TIMES - 1) * q:
                yield start, end + q, q
        width *= 2
        full[:] = -1
        full[at] = name
        then = full[np.minimum(at + group, len(x))]
        pair = then >= 0
        at, name = at[pair], name[pair] * len(full) + then[pair]
        group *= 2


def runs(x: np.ndarray) -> np.ndarray:
    """All runs of ``x`` as rows (start, length, period), by start, then period.

    A run is a stretch with smallest period q (values q apart are equal), of LEAST_WORDS values and
    LEAST_TIMES * q at least, that no neighbouring value extends keeping q.
    """
    found: dict[tuple[int, int], int] = {}
    for q in range(1, SHORT):
        if len(x) < LEAST_TIMES * q:
            break
        for a, b in zip(*_stretches(x[q:] == x[:-q], max(LEAST_WORDS, LEAST_TIMES * q) - q), strict=True):
            found.setdefault((int(a), int(b) + q), q)  # a multiple of a smaller period spans the same stretch
    for a, b, q in sorted(_long_runs(x), key=lambda r: r[2]):
        found.setdefault((a, b), q)
    out = np.array([(a, b - a, q) for (a, b), q in found.items()], np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _repeated(keys: list, counts: np.ndarray) -> np.ndarray:
    """The slot whose word each slot takes: the tail of one document in ten repeats its first words."""
    slot = np.arange(int(counts.sum()))
    before = np.cumsum(counts) - counts
    for key, n, base in zip(keys, counts.tolist(), before.tolist(), strict=True):
        h = zlib.crc32(str(key).encode()) if key is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            slot[base + a: base + n] = base + a + np.arange(n - a) % p
    return slot


_RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
_FIELDS = [
    StructField("n_words", LongType()), StructField("n_kept", LongType()), StructField("runs", ArrayType(_RUN)), StructField("runs_sha256", StringType()),
    StructField("collapsed", StringType()), StructField("collapsed_sha256", StringType()),
]


def _documents(keys: list, joined: bytes, offsets: np.ndarray, repeat: bool, texts: bool) -> list[list]:
    """One list of values for each field, over the rows of a chunk."""
    start, end, before = word_spans(joined, offsets)
    counts = np.diff(before)
    code = distinct(joined, start, end)[0] if len(start) else start
    if repeat:
        slot = _repeated(keys, counts)
        start, end, code = start[slot], end[slot], code[slot]
    rows = len(counts)
    # a value that occurs once behind each row keeps runs inside rows
    row = np.repeat(np.arange(rows), counts)
    x = np.empty(len(code) + rows, np.int64)
    base = before[:-1] + np.arange(rows)
    x[np.arange(len(code)) + row] = code
    x[base + counts] = len(code) + 1 + np.arange(rows)
    found = runs(x)
    of = np.searchsorted(base, found[:, 0], "right") - 1
    found[:, 0] -= base[of]
    first = np.searchsorted(of, np.arange(rows + 1))
    # words behind the first period of a run go
    edge = np.zeros(len(code) + 1, np.int64)
    at = before[of] + found[:, 0]
    np.add.at(edge, at + found[:, 2], 1)
    np.add.at(edge, at + found[:, 1], -1)
    keep = np.cumsum(edge[:-1]) == 0
    kept = np.bincount(row[keep], minlength=rows)
    # kept words with one blank behind each
    start, size = start[keep], (end - start)[keep]
    raw = np.frombuffer(joined + b" ", np.uint8)
    place = spread(start, size + 1)
    blank = np.cumsum(size + 1) - 1
    place[blank] = len(raw) - 1
    body = raw[place].tobytes()
    cut = np.concatenate([[0], blank + 1])[np.concatenate([[0], np.cumsum(kept)])]
    out: list[list] = [counts.tolist(), kept.tolist(), [], [], [], []]
    for i in range(rows):
        own = found[first[i]: first[i + 1]].tolist()
        text = body[cut[i]: max(cut[i], cut[i + 1] - 1)]
        out[2].append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
        out[3].append(sha256("".join(f"{s},{n},{q}\n" for s, n, q in own).encode()).hexdigest())
        out[4].append(text.decode() if texts else None)
        out[5].append(sha256(text).hexdigest())
    return out


def periodic_runs(docs: DataFrame, key: str = "doc_id", repeat: bool = False, texts: bool = True) -> DataFrame:
    """The runs of every row's ``text``, and the text with each run collapsed to its first period.

    Columns: ``key``, ``n_words``, ``n_kept``, ``runs`` (array of start, length, period; by start, then
    period), ``runs_sha256`` (of ``start,length,period`` lines), ``collapsed`` (the words outside runs and
    the first period of each run, joined by one blank; null without ``texts``) and ``collapsed_sha256``.
    Words are runs without ASCII white space, equal if their bytes are. A word goes if any run holds it
    behind that run's first period. ``repeat`` first makes the tail of one document in ten periodic (by
    crc32 of the key), to show the operator on runs of every length.

    A null, empty or blank text has no words and no runs; a null key repeats nothing. Repeated rows each
    give their row. Nothing is shuffled. A text is read whole: memory in a task grows with the longest
    text (about 40 bytes for each of its bytes), time with its words and the logarithm of its longest period.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        types = [pa.int64(), pa.int64(), kinds, pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for first, end, joined, offsets in chunks(batch.column(1)):
                keys = batch.column(0).slice(first, end - first)
                values = _documents(keys.to_pylist() if repeat else [None] * len(keys), joined, offsets, repeat, texts)
                yield pa.RecordBatch.from_arrays(
                    [keys, *(pa.array(v, t) for v, t in zip(values, types, strict=True))], [key, *(f.name for f in _FIELDS)])

    return docs.select(key, "text").mapInArrow(run, StructType([docs.schema[key], *_FIELDS]))


def strongest(runs_column: str = "runs"):
    """The run with the greatest length / period; of equal ones the first, then the one of the smallest period; null without runs.

    Whole times and the rest by the period are compared; the quotient of two numbers below 2^26 is exact
    enough in a double to tell any two of them apart.
    """
    ranked = F.transform(runs_column, lambda r: F.struct(
        (-(r["length"] - r["length"] % r["period"]) / r["period"]).alias("times"), (-(r["length"] % r["period"]) / r["period"]).alias("rest"),
        r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(ranked)
