"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its hashed subwords (runs of two to four bytes of lower-cased
text that cross no white space but may begin or end with it). Embeddings and the softmax are trained
together by stochastic gradient descent in numpy; a held-back part of the sample sets the temperature of
the probabilities and the score under which a prediction is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .text import chunks

BITS = 15
BUCKETS = 1 << BITS
SIZES = (2, 3, 4)
DIMENSIONS = 16
#: Labelled rows of each language that the fit draws, by hash of the key.
SAMPLE_PER_LANGUAGE = 1500
EPOCHS = 6
#: Of predictions as sure as the threshold or surer, at least this share is right on the held-back rows.
PRECISION = 0.99
UNKNOWN = "und"
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13, 0]] = True
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def subwords(joined: bytes, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts per row) for each size; buckets are in row order. Rows are set apart by spaces."""
    rows = len(offsets) - 1
    lowered = [joined[a:b].decode().lower().encode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    buf = np.frombuffer(b"".join(b" " + t + b" " for t in lowered), np.uint8)
    ends = np.cumsum([len(t) + 2 for t in lowered])
    space = _SPACE[buf]
    byte = np.where(space, np.uint8(32), buf).astype(np.uint32)
    out = []
    for size in SIZES:
        n = len(buf) - size + 1
        if n <= 0:
            out.append((np.zeros(0, np.int64), np.zeros(rows, np.int64)))
            continue
        h = np.full(n, size * 0x165667B1 & 0xFFFFFFFF, np.uint32)
        inner = np.zeros(n, bool)
        for k in range(size):
            h += byte[k: k + n] * _FACTORS[k]
            h ^= h >> np.uint32(15)
            if 0 < k < size - 1:
                inner |= space[k: k + n]
        if size == 2:
            inner |= space[:n] & space[1: n + 1]
        # the space that ends a row and the one that begins the next never share a subword: both ends would be inner
        keep = ~inner
        bucket = (h[keep] * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
        running = np.concatenate([[0], np.cumsum(keep)])
        cut = running[np.minimum(ends, n)]
        out.append((bucket.astype(np.int64), np.diff(cut, prepend=0)))
    return out


@dataclass
class Model:
    """Languages, the softmax's input of every bucket (embedding times weights), bias, temperature and threshold."""

    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, joined: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language index, probability) of each row."""
        rows, k = len(offsets) - 1, len(self.languages)
        total, count = np.zeros((rows, k)), np.zeros(rows)
        for bucket, per in subwords(joined, offsets):
            held = np.flatnonzero(per)
            if len(held):
                cuts = (np.cumsum(per) - per)[held]
                total[held] += np.add.reduceat(self.logits[bucket], cuts, axis=0, dtype=np.float64)
                count += per
        y = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        p = np.exp(y - y.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return p.argmax(1), p.max(1)


def fit_softmax(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: list[str]) -> Model:
    """``rows``: (distinct buckets, their counts, language index)."""
    k = len(languages)
    rng = np.random.default_rng(11)
    e, w, b = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)), np.zeros((DIMENSIONS, k)), np.zeros(k)
    w[:] = rng.normal(0, 0.3, w.shape)
    held = rng.permutation(len(rows)) % 5 == 0
    train = np.flatnonzero(~held) if (~held).any() else np.arange(len(rows))
    often = np.maximum(np.bincount([rows[i][2] for i in train], minlength=k), 1)
    weight = often.max() / often / (often.max() / often).max()
    steps, done = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(train):
            index, counts, label = rows[i]
            if not len(index):
                continue
            x = counts / counts.sum()
            mean = x @ e[index]
            y = mean @ w + b
            p = np.exp(y - y.max())
            p /= p.sum()
            p[label] -= 1
            rate = 0.5 * (1 - done / steps) + 1e-3
            done += 1
            g = rate * weight[label] * p
            back = w @ g
            w -= np.outer(mean, g)
            b -= 0.1 * g
            e[index] -= 20.0 * x[:, None] * back[None, :]
    model = Model(languages, (e @ w).astype(np.float32), b, 1.0, 0.0)
    test = np.flatnonzero(held) if held.any() else train
    y = np.array([(rows[i][1] / max(rows[i][1].sum(), 1)) @ model.logits[rows[i][0]] + b for i in test]).reshape(len(test), k)
    t = np.array([rows[i][2] for i in test])
    if len(test):
        def loss(temperature: float) -> float:
            z = y / temperature
            z = z - z.max(1, keepdims=True)
            return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(t)), t]).mean())

        model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
        z = y / model.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        sure = (p / p.sum(1, keepdims=True)).max(1)
        right = y.argmax(1) == t
        order = np.argsort(-sure, kind="stable")
        good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(t) + 1) >= PRECISION)
        model.threshold = float(sure[order[good[-1]]]) if len(good) else 1.0
    return model


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, joined, offsets in chunks(batch.column(0)):
            parts = subwords(joined, offsets)
            starts = [np.concatenate([[0], np.cumsum(per)]) for _, per in parts]
            index, counts = [], []
            for i in range(end - first):
                distinct, often = np.unique(np.concatenate([b[s[i]: s[i + 1]] for (b, _), s in zip(parts, starts, strict=True)]), return_counts=True)
                index.append(distinct.astype("<i4").tobytes())
                counts.append(often.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(index, pa.binary()), pa.array(counts, pa.binary()), batch.column(1).slice(first, end - first), batch.column(2).slice(first, end - first)],
                ["buckets", "counts", "lang", "order"])


def fit_languages(docs: DataFrame, key: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on about ``per_language`` rows of each language, drawn by hash of the key.

    Only rows with a text, a language and a crc32 of the key that leaves a remainder other than 1 by 3 may
    teach (a null key never does). The number of languages bounds what the driver holds. Without such
    rows the model knows no language.
    """
    able = docs.select(key, "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) != 1))
    counts = {r["lang"]: r["n"] for r in able.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    limits = F.map_from_arrays(F.array(*map(F.lit, counts)), F.array(*(F.lit(per_language / n) for n in counts.values())))
    draw = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    chosen = able.filter(draw < limits[F.col("lang")]).select("text", "lang", F.xxhash64(key, "text").alias("order"))
    got = chosen.mapInArrow(_sampled, "buckets binary, counts binary, lang string, order long").collect()
    languages = sorted(counts)
    rows = [(np.frombuffer(r["buckets"], "<i4").astype(np.int64), np.frombuffer(r["counts"], "<i4").astype(np.float64), languages.index(r["lang"]))
            for r in sorted(got, key=lambda r: (r["order"], r["lang"]))]
    return fit_softmax(rows, languages)


def predict_languages(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score, rejected) of every row: its whole text's language and calibrated probability.

    ``lang_pred`` is a learned language, or ``und`` with score 0 where the text is null, has no letter or
    no language was learned. ``rejected`` marks those and predictions under the calibrated threshold.
    Only ``text`` is read; nothing is shuffled.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS numbers for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        names = np.array([*own.languages, UNKNOWN], object)
        for batch in batches:
            for first, end, joined, offsets in chunks(batch.column(1)):
                lettered = pc.match_substring_regex(pc.fill_null(batch.column(1).slice(first, end - first), ""), r"\pL").to_numpy(zero_copy_only=False)
                if own.languages:
                    best, score = own.predict(joined, offsets)
                else:
                    best, score, lettered = np.zeros(end - first, np.int64), np.zeros(end - first), np.zeros(end - first, bool)
                best, score = np.where(lettered, best, len(names) - 1), np.where(lettered, score, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(names[best], pa.string()), pa.array(score), pa.array(~lettered | (score < own.threshold))],
                    [key, "lang_pred", "score", "rejected"])

    fields = [docs.schema[key], StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())]
    return docs.select(key, "text").mapInArrow(run, StructType(fields))
