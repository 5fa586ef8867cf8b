"""Document quality by a factorisation machine over hashed words, structure statistics and size metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .text import chunks

BITS = 15
BUCKETS = 1 << BITS
RANK = 8
#: Labelled rows of each class that the fit draws, by hash of the key.
SAMPLE_PER_CLASS = 3000
EPOCHS = 8
STATISTICS = (
    "log_words", "log_bytes", "log_lines", "word_length", "upper", "punctuation", "symbols", "exclamations", "bars", "digits",
    "non_ascii", "distinct_words", "top_word", "repeated_words", "symbol_endings", "sentence_words", "line_words",
)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _table(characters: str) -> np.ndarray:
    out = np.zeros(256, np.float32)
    out[[ord(c) for c in characters]] = 1
    return out


_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _table("0123456789")
_PUNCTUATION = _table(".,;:!?'\"()-")
_SYMBOL = _table("#$%&*@<>{}[]=_~^\\/+`")
_STOP = _table(".!?")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


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
            steps[1:] = _ODD_INVERSE
            cls.down = np.cumprod(steps, dtype=np.uint64)
        return cls.up[:n], cls.down[:n]


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, hash) of the words of each row; the hash ignores the case of A-Z."""
    n = len(buf)
    space = _SPACE[buf]
    begins = ~space
    begins[1:] &= space[:-1]
    stops = ~space
    stops[:-1] &= space[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    begins[inner] = ~space[inner]
    stops[inner - 1] = ~space[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    up, down = _Powers.of(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[buf].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return start, end, np.searchsorted(offsets, start, "right") - 1, h ^ (h >> np.uint64(29))


def features(joined: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of the hashed words, sorted by row, and the statistics of each row.

    Word values are square roots of counts, scaled to length one per row. A row without words has no
    word values and statistics of zero.
    """
    rows = len(offsets) - 1
    buf = np.frombuffer(joined, np.uint8)
    stats = np.zeros((rows, len(STATISTICS)), np.float32)
    empty = np.zeros(0, np.int64)
    if not len(buf):
        return empty, empty, np.zeros(0, np.float32), stats
    start, end, row, h = words(buf, offsets)
    bucket = (h >> np.uint64(64 - BITS)).astype(np.int64)
    pair, count = np.unique(row * BUCKETS + bucket, return_counts=True)
    of = pair >> BITS
    value = np.sqrt(count).astype(np.float32)
    n_words = np.bincount(row, minlength=rows).astype(np.float64)
    value /= np.sqrt(n_words)[of]  # the squares of a row's values sum to its word count
    size = np.diff(offsets).astype(np.float64)

    def share(table: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0], np.cumsum(table[buf], dtype=np.float64)])
        return running[offsets[1:]] - running[offsets[:-1]]

    lines = share(_table("\n")) + 1
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    top = np.zeros(rows)
    np.maximum.at(top, of, count)
    one, some = np.maximum(n_words, 1), np.maximum(size, 1)
    columns = (
        np.log1p(n_words), np.log1p(size), np.log(lines), np.bincount(row, weights=end - start, minlength=rows) / one,
        share(_UPPER) / some, share(_PUNCTUATION) / some, share(_SYMBOL) / some, share(_table("!")) / some, share(_table("|")) / some,
        share(_DIGIT) / some, share((np.arange(256) > 127).astype(np.float32)) / some, np.bincount(of, minlength=rows) / one, top / one,
        np.bincount(row, weights=again, minlength=rows) / one,
        np.bincount(row, weights=_SYMBOL[buf[end - 1]] + _table("!")[buf[end - 1]], minlength=rows) / one,
        np.log1p(n_words / (1 + share(_STOP))), np.log1p(n_words / lines),
    )
    stats[:] = np.stack(columns, 1)
    stats[n_words == 0] = 0
    return of, pair & (BUCKETS - 1), value, stats


@dataclass
class Machine:
    """y = bias + sum w x + 1/2 sum_f ((sum v x)^2 - sum v^2 x^2); a score is the logistic of slope * y + offset."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    slope: float
    offset: float

    def standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4) / 4

    def raw(self, row, bucket, value, stats, rows: int) -> np.ndarray:
        """Pairwise terms of all rows in time linear in the values, by the sum-of-squares identity."""
        x = self.standard(stats)
        linear = np.bincount(row, weights=self.w[bucket] * value, minlength=rows) + x @ self.w[BUCKETS:]
        vx = self.v[bucket] * value[:, None]
        sums = np.zeros((rows, self.v.shape[1]))
        squares = np.zeros(rows)
        if len(row):
            cuts = np.flatnonzero(np.diff(row, prepend=-1))
            sums[row[cuts]] = np.add.reduceat(vx, cuts, axis=0)
            squares[row[cuts]] = np.add.reduceat((vx * vx).sum(1), cuts)
        tail = self.v[BUCKETS:]
        sums += x @ tail
        squares += (x * x) @ (tail * tail).sum(1)
        return self.bias + linear + 0.5 * ((sums * sums).sum(1) - squares)

    def score(self, joined: bytes, offsets: np.ndarray) -> np.ndarray:
        y = self.slope * self.raw(*features(joined, offsets), len(offsets) - 1) + self.offset
        return 1 / (1 + np.exp(-np.clip(y, -60, 60)))


def constant(share: float) -> Machine:
    share = min(max(share, 1e-6), 1 - 1e-6)
    k = len(STATISTICS)
    return Machine(0.0, np.zeros(BUCKETS + k), np.zeros((BUCKETS + k, 1), np.float32), np.zeros(k), np.ones(k), 0.0, float(np.log(share / (1 - share))))


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], prior: float) -> Machine:
    """Adaptive stochastic gradient descent on the logistic loss; ``rows`` holds (buckets, values, statistics, label).

    Classes weigh alike in the fit. A fifth of the rows then sets slope and offset, and the offset moves
    the balanced odds to those of ``prior``, the share of label 1.
    """
    labels = np.array([r[3] for r in rows])
    if not len(rows) or labels.min() == labels.max():
        return constant(0.5 if not len(rows) else float(labels[0]))
    rng = np.random.default_rng(7)
    stats = np.stack([r[2] for r in rows]).astype(np.float64)
    machine = constant(0.5)
    machine.mean, machine.scale = stats.mean(0), np.maximum(stats.std(0), 1e-6)
    k = BUCKETS + len(STATISTICS)
    w, v = np.zeros(k), rng.normal(0, 0.02, (k, RANK))
    seen_w, seen_v, bias, seen_b = np.full(k, 1e-2), np.full((k, RANK), 1e-2), 0.0, 1e-2
    x = machine.standard(stats)
    own = np.arange(BUCKETS, k)
    held = rng.permutation(len(rows)) % 5 == 0
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    for _ in range(EPOCHS):
        for i in rng.permutation(np.flatnonzero(~held)):
            index = np.concatenate([rows[i][0], own])
            value = np.concatenate([rows[i][1], x[i]])
            vi = v[index]
            sums = value @ vi
            y = bias + w[index] @ value + 0.5 * (sums @ sums - ((vi * value[:, None]) ** 2).sum())
            g = weight[i] * (1 / (1 + np.exp(-np.clip(y, -60, 60))) - labels[i])
            gw = g * value + 1e-5 * w[index]
            gv = g * (value[:, None] * sums - vi * (value * value)[:, None]) + 1e-5 * vi
            seen_w[index] += gw * gw
            seen_v[index] += gv * gv
            seen_b += g * g
            w[index] -= 0.1 * gw / np.sqrt(seen_w[index])
            v[index] -= 0.05 * gv / np.sqrt(seen_v[index])
            bias -= 0.1 * g / np.sqrt(seen_b)
    machine.bias, machine.w, machine.v = bias, w, v.astype(np.float32)
    test = np.flatnonzero(held)
    size = np.array([len(rows[i][0]) for i in test])
    y = machine.raw(np.repeat(np.arange(len(test)), size), np.concatenate([rows[i][0] for i in test]) if len(test) else np.zeros(0, np.int64),
                    np.concatenate([rows[i][1] for i in test]) if len(test) else np.zeros(0), stats[test], len(test))
    slope, offset, t = 1.0, 0.0, labels[test]
    for _ in range(30):  # Newton steps of the logistic calibration, held near slope 1 by a weak prior
        p = 1 / (1 + np.exp(-np.clip(slope * y + offset, -60, 60)))
        d, e = weight[test] * (p - t), weight[test] * p * (1 - p)
        grad = np.array([(d * y).sum() + (slope - 1), d.sum() + offset])
        hess = np.array([[(e * y * y).sum() + 1, (e * y).sum()], [(e * y).sum(), e.sum() + 1]])
        step = np.linalg.solve(hess, grad)
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-8:
            break
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    machine.slope, machine.offset = float(slope), float(offset + np.log(prior / (1 - prior)))
    return machine


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, joined, offsets in chunks(batch.column(0)):
            row, bucket, value, stats = features(joined, offsets)
            cuts = np.searchsorted(row, np.arange(end - first + 1))
            yield pa.RecordBatch.from_arrays([
                pa.array([bucket[a:b].astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                pa.array([value[a:b].astype("<f4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                pa.array([s.astype("<f4").tobytes() for s in stats], pa.binary()), batch.column(1).slice(first, end - first),
                batch.column(2).slice(first, end - first)], ["buckets", "values", "stats", "label", "order"])


def learnable(key: str = "doc_id"):
    """Rows that may teach: their remainder of crc32 by 3 is not 1 (a null key never teaches)."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) != 1


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", per_class: int = SAMPLE_PER_CLASS) -> Machine:
    """Fit on about ``per_class`` learnable labelled rows of each class, drawn by hash of the key.

    Labels other than 0 and 1 are ignored; a key with both has no label. Without rows of both classes the
    machine is constant: the only class, or 0.5 without labels.
    """
    marks = labels.select(key, F.col("quality").cast("int").alias("label")).filter(learnable(key) & F.col("label").isin(0, 1))
    marks = marks.groupBy(key).agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")
    counts = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return constant(0.5)
    draw = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    limit = F.when(F.col("label") == 1, F.lit(per_class / counts.get(1, 1))).otherwise(F.lit(per_class / counts.get(0, 1)))
    # about 2 * per_class keys: the sample's own bound
    chosen = marks.filter(draw < limit)
    taught = docs.select(key, "text").join(F.broadcast(chosen), key).select("text", "label", F.xxhash64(key, "text").alias("order"))
    got = taught.mapInArrow(_sampled, "buckets binary, values binary, stats binary, label int, order long").collect()
    rows = [(np.frombuffer(r["buckets"], "<i4").astype(np.int64), np.frombuffer(r["values"], "<f4").astype(np.float64), np.frombuffer(r["stats"], "<f4"), r["label"])
            for r in sorted(got, key=lambda r: r["order"])]
    return fit_machine(rows, counts.get(1, 0) / sum(counts.values()))


def quality_scores(docs: DataFrame, machine: Machine, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from 0.5 on).

    Only ``text`` is read, whole; a null text counts as empty and is scored from its statistics. Kept
    columns of those two names are replaced. Nothing is shuffled.
    """
    held = docs.sparkSession.sparkContext.broadcast(machine)  # a megabyte, fixed by BITS and RANK
    names = [c for c in keep if c not in ("score", "predicted")]
    at = names.index("text") if "text" in names else len(names)
    read = docs.select(*names, *(["text"] if at == len(names) else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, joined, offsets in chunks(batch.column(at)):
                scores = pa.array(held.value.score(joined, offsets), pa.float64())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, end - first) for i in range(len(names))), scores], [*names, "score"])

    schema = StructType([*read.schema.fields[: len(names)], StructField("score", DoubleType())])
    return read.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
