"""Vectors of a table as float64 blocks: which of them take part, and codebooks fitted on a bounded sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(column: str = "embedding"):
    """The vector is not null, not empty, not zero, and holds neither null nor non-finite components."""
    def finite(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return F.coalesce(F.forall(column, finite) & F.exists(column, lambda x: x != 0), F.lit(False))


def block(column: pa.Array, dim: int) -> np.ndarray:
    """A column of packed vectors of ``dim`` components as a float64 matrix."""
    rows = column.to_pylist()
    if not rows:
        return np.zeros((0, dim))
    return np.frombuffer(b"".join(rows), f"<f{len(rows[0]) // dim}").reshape(len(rows), dim).astype(np.float64)


def packed(vectors: DataFrame, names: dict[str, object], embedding: str = "embedding") -> DataFrame:
    """``names`` (alias to column) and ``vec``: usable vectors as little-endian bytes of their own precision, with their length ``dim``."""
    kind = "f" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "d"
    picked = vectors.filter(usable(embedding)).select(
        *[c.alias(n) for n, c in names.items()], F.col(embedding).cast("array<float>" if kind == "f" else "array<double>").alias("vec"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]) + ", vec binary, dim int"

    def run(batches):
        for batch in batches:
            values = batch.column(batch.num_columns - 1)
            flat = values.flatten().to_numpy(zero_copy_only=False).astype("<f4" if kind == "f" else "<f8")
            ends = np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))
            data = [part.tobytes() for part in np.split(flat, ends[:-1])] if len(ends) else []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(data, pa.binary()), pa.array(np.diff(ends, prepend=0), pa.int32())], [*batch.schema.names[:-1], "vec", "dim"])

    return picked.mapInArrow(run, schema)


def sample(packed_: DataFrame, key: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors of about ``most`` rows, drawn by hash of ``key``; the vectors of the most frequent length only."""
    sizes = packed_.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    draw = F.pmod(F.xxhash64(key, F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    rows = packed_.filter((F.col("dim") == sizes["dim"]) & (draw < most / sizes["n"])).select(key, "vec").collect()
    rows.sort(key=lambda r: (r[key], r["vec"]))
    return np.array([r[key] for r in rows], np.int64), block(pa.array([r["vec"] for r in rows], pa.binary()), sizes["dim"])


def means(points: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means centres of distinct ``points``; fewer where there are fewer points."""
    points = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    centres = points[np.sort(rng.permutation(len(points))[:k])]
    for _ in range(rounds):
        near = ((centres ** 2).sum(1) - 2 * points @ centres.T).argmin(1)
        count = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return np.unique(centres, axis=0)
