"""Near-duplicate embeddings by an inverted multi-index.

Vectors of length one are cut in halves, and each half has a codebook of its own; the product of the two
is a grid of cells with inverted lists. A vector visits the cells whose lower bound of the distance to any
vector that they can hold, a sum of one bound for each half, is within the radius of the target cosine. The
bound is exact, so the target recall is 1: no pair within the radius is in a cell that was not visited.

The lists of a label, in the order of their cells, are cut into shelves of equal length. A vector travels once for each
shelf that holds a cell it visits, not once for each cell; the cells are visited where two shelves meet, and every
candidate is then verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import components, cut, few, local_roots
from .vectors import block, means, packed

SAMPLE, MOST_CODES = 8192, 256
#: Rows of a list and of its visitors that are compared at a time, and most components of a shelf.
BLOCK, VISITORS, SHELF = 1024, 4096, 1 << 24
_SLACK = 1e-9


@dataclass
class Grid:
    """Codebooks of the two halves."""

    left: np.ndarray
    right: np.ndarray

    def _bounds(self, x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest code of each row, and for each code the squared distance from the row to the code's region.

        A region lies behind the plane midway between its code and the row's nearest code.
        """
        gaps = np.maximum((x ** 2).sum(1)[:, None] + (codes ** 2).sum(1)[None, :] - 2 * x @ codes.T, 0)
        near = gaps.argmin(1)
        apart = np.sqrt(((codes[:, None, :] - codes[None, :, :]) ** 2).sum(2))[near]
        reach = (gaps - gaps[np.arange(len(x)), near][:, None]) / np.maximum(2 * apart, 1e-300)
        reach[np.arange(len(x)), near] = 0
        return near, np.maximum(reach, 0) ** 2

    def cells(self, x: np.ndarray) -> np.ndarray:
        h = x.shape[1] // 2
        return self._bounds(x[:, :h], self.left)[0] * len(self.right) + self._bounds(x[:, h:], self.right)[0]

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of each row to the regions of the left and of the right codes."""
        h = x.shape[1] // 2
        return self._bounds(x[:, :h], self.left)[1], self._bounds(x[:, h:], self.right)[1]

    def visits(self, x: np.ndarray, radius: float) -> list[list[int]]:
        """The cells that each row visits: all whose bound is within ``radius``."""
        left, right = self.bounds(x)
        return [np.flatnonzero((u[:, None] + v[None, :]).ravel() <= radius ** 2 + _SLACK).tolist() for u, v in zip(left, right, strict=True)]

    def reaches(self, left: np.ndarray, right: np.ndarray, first: int, last: int, radius: float) -> np.ndarray:
        """Which rows of these bounds visit a cell from ``first`` to ``last``."""
        (p, q), (s, t) = divmod(first, len(self.right)), divmod(last, len(self.right))
        if p == s:
            least = left[:, p] + right[:, q: t + 1].min(1)
        else:
            least = np.minimum(left[:, p] + right[:, q:].min(1), left[:, s] + right[:, : t + 1].min(1))
            if s > p + 1:
                least = np.minimum(least, left[:, p + 1: s].min(1) + right.min(1))
        return least <= radius ** 2 + _SLACK


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _placed(grid: Grid, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, VISITORS):
                part = batch.slice(first, VISITORS)
                cells = grid.cells(_unit(block(part.column("vec"), dim)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells, pa.int32())], [*part.schema.names, "cell"])

    return run


_SENT = "kind int, lot long, low int, high int, label long, own int, nodes binary, ns binary, vecs binary"


def _sent(grid: Grid, dim: int, radius: float):
    """Rows of one shelf that go to one pair of shelves, BLOCK to a row: to the pair of their own with each that they visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple[np.ndarray, ...]]] = {}
        sizes: dict[tuple, int] = {}

        def out(keys):
            rows = [(*k[:2], min(k[3:]), max(k[3:]), k[2], k[3], *(np.concatenate(c).tobytes() for c in zip(*held.pop(k), strict=True))) for k in keys]
            for k in keys:
                del sizes[k]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (
                pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names)

        names = [f.split()[0] for f in _SENT.split(", ")]
        for batch in batches:
            for first in range(0, batch.num_rows, VISITORS):
                part = batch.slice(first, VISITORS)
                node, n, label, own, kind, lot = (part.column(c).to_numpy() for c in ("node", "n", "label", "own", "kind", "lot"))
                raw = np.frombuffer(b"".join(part.column("vec").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                order = np.lexsort((own, label))
                for at in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
                    ranges = part.column("ranges")[int(at[0])].as_py() or []
                    if len(ranges) > 1:
                        left, right = grid.bounds(_unit(block(part.column("vec").take(pa.array(at)), dim)))
                    for other in range(max(1, len(ranges))):
                        to = at
                        if len(ranges) > 1:
                            to = at[grid.reaches(left, right, ranges[other]["first"], ranges[other]["last"], radius) | (own[at] == other)]
                        for group in np.split(to, np.flatnonzero(np.diff(own[to])) + 1):
                            if len(group):
                                key = (int(kind[at[0]]), int(lot[at[0]]), int(label[at[0]]), int(own[group[0]]), other)
                                held.setdefault(key, []).append((node[group], n[group], raw[group]))
                                sizes[key] = sizes.get(key, 0) + len(group)
                full = [k for k, size in sizes.items() if size >= BLOCK]
                if full:
                    yield out(full)
                if sum(sizes.values()) * dim > 4 * SHELF:
                    yield out(list(sizes))
        if sizes:
            yield out(list(sizes))

    return run


def _links(grid: Grid, dim: int, least: float, radius: float, visitors: np.ndarray, hosts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in ``visitors``, in ``hosts``) of the vectors that link: each visitor is compared with the lists of the cells that it visits.

    Single precision rules out or accepts what its rounding cannot change, double precision decides the rest.
    """
    x = np.concatenate([_unit(hosts[i: i + VISITORS]).astype(np.float32) for i in range(0, len(hosts), VISITORS)])
    cell = np.concatenate([grid.cells(_unit(hosts[i: i + VISITORS])) for i in range(0, len(hosts), VISITORS)]) if len(hosts) > BLOCK // 16 else np.zeros(len(hosts), np.int64)
    order = np.argsort(cell, kind="stable")
    lists = [(int(cell[at[0]]), at[i: i + BLOCK]) for at in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) for i in range(0, len(at), BLOCK)]
    lists = [(*divmod(c, len(grid.right)), at, np.ascontiguousarray(x[at].T)) for c, at in lists]
    slack, stop = (dim + 4) * 1.2e-7, radius ** 2 + _SLACK
    for first in range(0, len(visitors), VISITORS):
        y = _unit(visitors[first: first + VISITORS])
        single = y.astype(np.float32)
        left, right = (np.asfortranarray(b) for b in grid.bounds(y)) if len(hosts) > BLOCK // 16 else (np.zeros((len(y), len(grid.left))), np.zeros((len(y), len(grid.right))))
        for p, q, at, listed in lists:
            ask = np.flatnonzero(left[:, p] + right[:, q] <= stop)
            cosine = single[ask] @ listed
            near = np.flatnonzero(cosine >= least - slack)
            if not len(near):
                continue
            i, j = divmod(near, len(at))
            open_ = np.flatnonzero(cosine.ravel()[near] < least + slack)
            sure = np.ones(len(i), bool)
            for k in np.split(open_, range(VISITORS, len(open_), VISITORS)):
                a, b = y[ask[i[k]]], _unit(hosts[at[j[k]]])
                exact = (a * b).sum(1)
                for m in np.flatnonzero(np.abs(exact - least) < 1e-12):  # at the limit the exact sum decides
                    exact[m] = math.fsum(a[m] * b[m])
                sure[k] = exact >= least
            yield first + ask[i[sure]], at[j[sure]]


def _linked(grid: Grid, dim: int, least: float, radius: float):
    """Links between two shelves, or in one: how many vectors each reaches, and a spanning forest of the links."""

    def run(rows: pa.Table) -> pa.Table:
        labels, own = (rows.column(c).to_numpy() for c in ("label", "own"))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        forest: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.lexsort((own, labels))
        for at in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1):
            sides = []
            for mine in np.split(at, np.flatnonzero(np.diff(own[at])) + 1):
                node, n, vec = (b"".join(rows.column(c).take(pa.array(mine)).to_pylist()) for c in ("nodes", "ns", "vecs"))
                node, n = np.frombuffer(node, np.int64), np.frombuffer(n, np.int64)
                sides.append((node, n, np.frombuffer(vec, f"<f{len(vec) // dim // len(node)}").reshape(len(node), dim)))
            same = rows.column("low")[int(at[0])] == rows.column("high")[int(at[0])]
            if len(sides) == 1 and not same:
                continue  # nobody came from the other shelf
            (host, host_n, hosts), (ask, ask_n, asks) = sides[0], sides[-1]
            found = np.zeros(len(ask)), np.zeros(len(host))
            for i, j in _links(grid, dim, least, radius, asks, hosts):
                other = ask[i] != host[j]
                i, j = i[other], j[other]
                if len(i):
                    found[0][:] += np.bincount(i, weights=host_n[j], minlength=len(ask))
                    if not same:
                        found[1][:] += np.bincount(j, weights=ask_n[i], minlength=len(host))
                    nodes, roots = local_roots(ask[i], host[j])
                    forest.append((nodes[nodes != roots], roots[nodes != roots]))
            for nodes, counts in ((ask, found[0]), (host, found[1])):
                some = counts > 0
                out.append((nodes[some], nodes[some], counts[some].astype(np.int64)))
        if forest:
            nodes, roots = local_roots(*(np.concatenate(c) for c in zip(*forest, strict=True)))
            tree = nodes != roots
            out.append((nodes[tree], roots[tree], np.zeros(int(tree.sum()), np.int64)))
        src, dst, counts = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "found": pa.array(counts, pa.int64())})

    return run


def near_embeddings(vectors: DataFrame, least: float = 0.98, key: str = "vec_id", label: str = "label", embedding: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) of every row: which vectors are near copies under one label.

    Two vectors link if their labels are equal and not null, both take part, their lengths agree and their cosine in double precision
    is at least ``least``. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and so
    do rows with a null label or key; they are their own component (a null key has a null one) and kept.
    ``n_links`` counts the other vectors (keys) linked directly; a repeated key with one vector is one
    vector. Equal vectors of a label (of one SHA-256 digest) collapse before the search and weigh as many as they are. A label of n
    of all N vectors has about n / (64 sqrt(N)) shelves, and a vector travels at most that often; links leave a
    pair of shelves as counts and a spanning forest, never as pairs.
    """
    spark = vectors.sparkSession
    usable = packed(vectors.filter(F.col(key).isNotNull() & F.col(label).isNotNull()), {"id": F.col(key).cast("long"), "label": F.col(label).cast("long")}, embedding)
    usable = usable.withColumn("print", F.unhex(F.sha2("vec", 256)))
    members = cut(usable.select("id", "label", "dim", "print").distinct())
    distinct = cut(members.groupBy("label", "dim", "print").agg(F.min("id").alias("node"), F.count("*").alias("n")))
    radius = math.sqrt(2 - 2 * least)
    counted, trees = [], []
    for size in [r["dim"] for r in distinct.select("dim").distinct().orderBy("dim").collect()]:
        found = _cells(usable.filter(F.col("dim") == size).drop("dim"), distinct.filter(F.col("dim") == size).drop("dim"), size, least, radius)
        counted.append(found.filter("src = dst").groupBy("src").agg(F.sum("found").alias("found")))
        trees.append(found.filter("src <> dst").select("src", "dst"))
    links = spark.createDataFrame([], "src long, dst long")
    counts = spark.createDataFrame([], "src long, found long")
    for c, t in zip(counted, trees, strict=True):
        counts, links = counts.unionAll(c), links.unionAll(t)
    roots = distinct.join(components(links), "node", "left").join(counts.withColumnRenamed("src", "node"), "node", "left").select(
        "label", "dim", "print", F.coalesce("root", "node").alias("root"), (F.coalesce("found", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    placed = members.join(roots, ["label", "dim", "print"]).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("root").alias("root"))
    joined = vectors.select(F.col(key).alias("_key")).join(placed, F.col("_key").cast("long") == F.col("id"), "left")
    component = F.coalesce("root", F.col("_key").cast("long"))
    return joined.select(F.col("_key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                         F.coalesce(component == F.col("_key"), F.lit(True)).alias("kept"))


def _cells(usable: DataFrame, distinct: DataFrame, dim: int, least: float, radius: float) -> DataFrame:
    """Put the vectors of one length into cells and shelves, and compare each shelf's visitors with its lists."""
    sizes = cut(distinct.groupBy("label").agg(F.count("*").alias("size")))
    rows, squares = sizes.agg(F.sum("size"), F.sum(F.col("size").cast("double") ** 2)).first()
    draw = F.pmod(F.xxhash64("print", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    drawn = usable.filter(draw < SAMPLE / rows).groupBy("print").agg(F.first("vec").alias("vec")).select("vec").collect()
    drawn = drawn or usable.select("vec").limit(1).collect()  # the draw found none of few rows
    points = _unit(block(pa.array(sorted(r["vec"] for r in drawn), pa.binary()), dim))
    # about 128 rows in a cell, of the label of a usual row
    codes, half = int(np.clip(2 ** round(math.log2(max(1.0, squares / rows / 128) ** 0.5)), 1, MOST_CODES)), dim // 2
    grid = Grid(means(points[:, :half], codes, 1), means(points[:, half:], codes, 2)) if half else Grid(np.zeros((1, 0)), means(points, codes, 2))
    # a shelf has BLOCK / 16 times the root of the rows, so that a vector's copies and the shelves of a task both grow as the root
    shelf = int(min(max(BLOCK, BLOCK // 16 * math.sqrt(rows)), max(BLOCK, SHELF // dim)))
    lists = usable.groupBy("label", "print").agg(F.first("vec").alias("vec")).join(distinct, ["label", "print"]).select("node", "label", "n", "vec")
    placed = cut(lists.mapInArrow(_placed(grid, dim), "node long, label long, n long, vec binary, cell int"))
    order = Window.partitionBy("label").orderBy("cell")
    begin, end = F.expr("before * shelves div size"), F.expr("(before + listed - 1) * shelves div size")
    counts = cut(placed.groupBy("label", "cell").agg(F.count("*").alias("listed")).join(sizes, "label").withColumn(
        "before", F.sum("listed").over(order) - F.col("listed")).withColumn("shelves", F.ceil(F.col("size") / shelf).cast("long")))
    ranges = cut(counts.filter("shelves > 1").select("label", "cell", F.explode(F.sequence(begin, end)).alias("own")).groupBy("label", "own").agg(
        F.min("cell").alias("first"), F.max("cell").alias("last")).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("own", "first", "last"))).alias("ranges")))
    # small labels share a group
    shared = sizes.filter(F.col("size") * 2 <= shelf).agg(F.sum("size")).first()[0] or 0
    alone = F.col("size") * 2 > shelf
    place = F.col("before") + F.pmod(F.xxhash64("node"), F.col("listed"))
    shelved = placed.join(counts, ["label", "cell"]).join(few(ranges, ranges.count()), "label", "left").select(
        "node", "label", "n", "vec", "ranges", F.floor(place * F.col("shelves") / F.col("size")).cast("int").alias("own"), alone.cast("int").alias("kind"),
        F.when(alone, F.col("label")).otherwise(F.pmod(F.xxhash64("label"), F.lit(max(1, shared // shelf)))).alias("lot"))
    return cut(shelved.mapInArrow(_sent(grid, dim, radius), _SENT).groupBy("kind", "lot", "low", "high").applyInArrow(
        _linked(grid, dim, least, radius), "src long, dst long, found long"))
