"""SimHash fingerprints and exact near-duplicate search by tiles.

Fingerprints that differ in at most ``radius`` bits differ by at most ``radius`` in population count, and
so does the sum of the differences over their 16-bit quarters. Distinct fingerprints are therefore packed
into tiles of one quarter-count signature, a tile meets only tiles whose signature is within the radius,
and each such pair of tiles is compared whole with numpy exclusive-or and bit counts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .tables import components, cut, free_names, local_roots
from .text import chunks

TILE = 256
_BITS_AT_ONCE = 1 << 17


def _hashes(text: bytes, width: int) -> list[int]:
    from xxhash import xxh64_intdigest

    words = text.split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxh64_intdigest(joined, 42)]
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    return [xxh64_intdigest(joined[a:b], 42) for a, b in zip([0, *(gaps + 1).tolist()], [*gaps[width - 1:].tolist(), len(joined)])]


def fingerprint(hashes: np.ndarray) -> int:
    """Bit k is 1 if it is set in over half of the hashes; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BITS_AT_ONCE):
        part = np.ascontiguousarray(hashes[at: at + _BITS_AT_ONCE])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, key: str = "doc_id") -> DataFrame:
    """(key, fingerprint long) of every whole ``text``: the signed form of the 64-bit SimHash.

    A-Z are lower-cased, words are runs without ASCII white space, shingles of ``width`` words count as
    often as they occur; a shorter text is one shingle. A null, empty or blank text has fingerprint 0.
    Null and repeated keys pass through. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for first, end, joined, offsets in chunks(batch.column(1)):
                joined = joined.lower()  # bytes: A-Z only
                for row, a, b in zip(range(first, end), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    out[row] = fingerprint(np.array(_hashes(joined[a:b], width), "<u8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], [key, "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, fingerprint long")


def _quarters(column: str) -> list:
    return [F.bit_count(F.shiftrightunsigned(column, 16 * k).bitwiseAND(0xFFFF)).cast("int") for k in range(4)]


def _near(radius: int) -> list[tuple[int, ...]]:
    """Differences of quarter counts within the radius; of each and its opposite only one, and zero."""
    every = [d for d in itertools.product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]
    return [d for d in every if d >= (0, 0, 0, 0)]


def _compared(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for left, right, left_ids, right_ids in zip(*columns, strict=True):
                x, y = (np.frombuffer(v, "<i8").view(np.uint64) for v in (left, right))
                i, j = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
                if len(i):
                    a, b = np.frombuffer(left_ids, "<i8")[i], np.frombuffer(right_ids, "<i8")[j]
                    nodes, roots = local_roots(a, b)  # a spanning forest of the links of this pair of tiles
                    found.append((nodes[nodes != roots], roots[nodes != roots]))
            if found:
                src, dst = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one signature become tiles of at most TILE fingerprints; a task's rows come sorted by signature."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        sig, node, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        cuts = [0, *(np.flatnonzero(np.diff(sig)) + 1).tolist(), len(sig)]
        rows: list[list] = [[], [], [], []]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for at in range(a, b, TILE):
                end = min(b, at + TILE)
                rows[0].append(int(sig[at]))
                rows[1].append(number)
                rows[2].append(fp[at:end].astype("<i8").tobytes())
                rows[3].append(node[at:end].astype("<i8").tobytes())
                number += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.binary())],
            ["signature", "tile", "fps", "ids"])


def near_links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Links (src, dst) that join all of ``distinct`` (node long, fingerprint long, both distinct) within ``radius`` bits.

    Every pair within the radius is compared; of the links found in a pair of tiles a spanning forest is
    returned, so that components are exact and a group of n near copies gives no n squared rows.
    """
    signed = distinct.select("node", "fingerprint", *(q.alias(f"q{k}") for k, q in enumerate(_quarters("fingerprint"))))
    signed = signed.select((((F.col("q0") * 17 + F.col("q1")) * 17 + F.col("q2")) * 17 + F.col("q3")).cast("long").alias("signature"), "node", "fingerprint")
    # a common signature is dealt over several tasks; there are at most 17^4 signatures, so their counts may be broadcast
    counts = F.broadcast(signed.groupBy("signature").agg(F.count("*").alias("n")))
    part = F.pmod(F.xxhash64("fingerprint"), F.ceil(F.col("n") / (16 * TILE)))
    met = signed.join(counts, "signature").select("signature", "node", "fingerprint", part.alias("part"))
    met = met.repartition("signature", "part").sortWithinPartitions("signature", "part").select("signature", "node", "fingerprint")
    tiles = cut(met.mapInArrow(_packed, "signature long, tile long, fps binary, ids binary"))
    digits = [F.floor(F.col("signature") / 17 ** k) % 17 for k in (3, 2, 1, 0)]
    moves = F.array(*[F.array(*map(F.lit, d)) for d in _near(radius)])
    visits = (
        tiles.select("tile", "fps", "ids", F.array(*digits).alias("own"), F.explode(moves).alias("move"))
        .select(F.col("tile").alias("tile2"), F.col("fps").alias("fps2"), F.col("ids").alias("ids2"), (F.aggregate("move", F.lit(0), lambda a, d: a + F.abs(d)) > 0).alias("moved"), *[(F.col("own")[k] + F.col("move")[k]).alias(f"d{k}") for k in range(4)])
        .filter(" and ".join(f"d{k} between 0 and 16" for k in range(4)))
        .select("tile2", "fps2", "ids2", "moved", (((F.col("d0") * 17 + F.col("d1")) * 17 + F.col("d2")) * 17 + F.col("d3")).cast("long").alias("signature"))
    )
    pairs = tiles.join(visits, "signature").filter("moved or tile <= tile2").select("fps", "fps2", "ids", "ids2")
    return pairs.mapInArrow(_compared(radius), "src long, dst long").filter("src <> dst")


def simhash_groups(docs: DataFrame, radius: int = 3, width: int = 3, key: str = "doc_id") -> DataFrame:
    """(key, fingerprint, component_id) for every row of ``docs``: groups of near copies.

    ``component_id`` is the smallest non-null key reachable over fingerprints that differ in at most
    ``radius`` bits, the row's own included. Equal fingerprints collapse before the search and share a
    component; texts without words share fingerprint 0. A null key keeps its row and takes the component
    of its fingerprint if any keyed row has it, else null. Keys must be whole numbers.
    """
    prints = cut(fingerprints(docs, width, key))
    distinct = cut(prints.groupBy("fingerprint").agg(F.min(F.col(key).cast(LongType())).alias("node")).filter("node is not null"))
    grouped = components(near_links(distinct, radius))
    roots = distinct.join(grouped, "node", "left").select("fingerprint", F.coalesce("root", "node").alias("component_id"))
    return prints.join(roots, "fingerprint", "left").select(key, "fingerprint", "component_id")


def representatives(docs: DataFrame, radius: int = 3, width: int = 3, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stand for their group: those whose key is the group's component, one row for each key.

    Rows of one key are one document; the row with the smallest hash of its text stays. Rows without a key
    stay, one for each fingerprint, where no keyed row is in their group. Columns stay as they are.
    """
    names = docs.columns
    root, row, mark, same, print_, lone = free_names(docs, "root_", "row_", "mark_", "same_", "print_", "lone_")
    groups = simhash_groups(docs, radius, width, key)
    roots = groups.filter(F.col(key) == F.col("component_id")).select(F.col(key).alias(root)).distinct()
    order = (F.xxhash64("text"), F.length("text"), F.col("text"))
    keyed = docs.join(roots, F.col(key) == F.col(root), "left_semi").withColumn(row, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    bare = docs.filter(F.col(key).isNull()).withColumn(mark, F.xxhash64("text"))
    prints = fingerprints(bare.select(mark, "text").distinct(), width, mark).withColumnsRenamed({"fingerprint": print_, mark: same})
    alone = groups.filter(F.col(key).isNull() & F.col("component_id").isNull()).select(F.col("fingerprint").alias(lone)).distinct()
    bare = bare.join(prints, F.col(mark) == F.col(same)).join(alone, F.col(print_) == F.col(lone), "left_semi")
    bare = bare.withColumn(row, F.row_number().over(Window.partitionBy(print_).orderBy(*order)))
    first = F.col(row) == 1
    return keyed.filter(first).select(*names).unionAll(bare.filter(first).select(*names))
