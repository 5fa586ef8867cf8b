"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of TABLES tables hashes a vector by several random projections, h = floor((a x + b) / w), and its
bucket is the tuple of these. A query visits its own bucket and perturbed ones (some h moved by one),
in the order of their estimated success: the sum of the squared distances to the boundaries crossed. It
visits as many as hold a row at the distance of its k-th nearest with probability RECALL, by its own place
in its slots; a query that no list of buckets brings there is compared with the whole table.
A short list is joined with the rows of its buckets. A long one does not travel: it is the set of buckets up to a cost, so
each table's cost tells whether a row within the query's bound lies in a visited bucket.
Candidates of all tables are merged and reranked by exact distance in double precision.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut
from .vectors import block, packed, sample

TABLES, HASHES = 4, 12
#: Slot width over the spread of the vectors, and the longest list of buckets that a query may visit in a table.
WIDTH, LIST = 3.0, 4096
#: Most vectors of the sample that bounds distances, rows of the table for each of them at least, recall that each
#: query's buckets must reach, and rows of a block of a bucket.
SAMPLE, SHARE, RECALL, BLOCK = 4096, 8, 0.96, 2048
QUERY_BLOCK = 512
#: Most buckets of a list that is joined with the rows. Of queries without such a list: rows of a part over the root of all rows,
#: queries of a lot that meets a part, queries and rows of a block there, most components of a part or lot, and pairs held at a time.
LISTED, PART, LOT, ASKS, ROWS = 128, 32, 65536, 512, 1024
COMPONENTS, HITS = 1 << 23, 1 << 20


@lru_cache(4)
def perturbations(hashes: int, most: int) -> np.ndarray:
    """Sets of moves as rows over the 2 * hashes moves ranked by cost, in the order of their expected success.

    The moves of rank j and 2 * hashes - 1 - j belong to one hash, so a set holds at most one of them. The
    costs are the expected order statistics of squared distances to the boundaries of a slot.
    """
    m = hashes
    j = np.arange(1, 2 * m + 1)
    back = 2 * m + 1 - j
    cost = np.where(j <= m, j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - back / (m + 1) + back * (back + 1) / (4 * (m + 1) * (m + 2))).tolist()
    heap, out = [(cost[0], (0,))], [()]
    while heap and len(out) < most:
        total, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < 2 * m:  # the next dearer move in place of the last one, or beside it
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
        if len({min(x, 2 * m - 1 - x) for x in chosen}) == len(chosen):
            out.append(chosen)
    rows = np.zeros((len(out), 2 * m))
    for i, chosen in enumerate(out):
        rows[i, list(chosen)] = 1
    return rows


@dataclass
class Index:
    """Projections (tables, hashes, dim), offsets and width of a slot."""

    a: np.ndarray
    b: np.ndarray
    width: float

    def slots(self, x: np.ndarray) -> np.ndarray:
        """(tables, rows, hashes) real positions; their floors are the hashes."""
        return (np.einsum("thd,nd->tnh", self.a, x) + self.b[:, None, :]) / self.width

    @staticmethod
    def names(table: int, hashes: np.ndarray) -> np.ndarray:
        """A 64-bit name of each bucket of a table. Two buckets that share one only add candidates."""
        out = np.full(hashes.shape[:-1], 0x9E3779B97F4A7C15 * (table + 1) & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for k in range(hashes.shape[-1]):
            out = (out ^ hashes[..., k].astype(np.int64).view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
        return out.view(np.int64)

    def plan(self, x: np.ndarray, bound: np.ndarray, recall: float = RECALL, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each row the names of the buckets that it visits, and the largest cost of a bucket that it visits in each table.

        No names and infinite costs where no list of buckets has the recall, no names where a list has more than ``most``.
        A row at distance d moves each position by a normal step of deviation d, so the chance of a bucket is a product
        over the hashes, and a row is missed if all tables miss it. Nearer rows have a larger chance than one at ``bound``.
        """
        m = self.a.shape[1]
        template = perturbations(m, LIST)
        base, inside = self.placed(x)
        none = np.zeros(0, np.int64), np.full(len(self.a), np.inf)
        for i in range(len(x)):
            if not np.isfinite(bound[i]):
                yield none
                continue
            chances, turns, costs = np.empty((len(self.a), len(template))), [], []
            scale = self.width / max(float(bound[i]), 1e-9 * self.width)
            for table in range(len(self.a)):
                f = inside[table, i]
                edges = _normal(np.stack([-1 - f, -f, 1 - f, 2 - f]) * scale)
                down, stay, up = np.maximum(np.diff(edges, axis=0), 1e-300)
                cost = np.concatenate([f ** 2, (1 - f) ** 2])
                order = np.argsort(cost, kind="stable")
                gain = np.log(np.concatenate([down, up])) - np.log(np.concatenate([stay, stay]))
                total = template @ cost[order]
                turn = np.argsort(total, kind="stable")
                chances[table] = np.exp(np.log(stay).sum() + (template @ gain[order])[turn]).cumsum()
                turns.append((turn, order))
                costs.append(total[turn])
            enough = np.flatnonzero(np.prod(1 - np.minimum(chances, 1), axis=0) <= 1 - recall)
            if not len(enough):
                yield none
                continue
            last, names = int(enough[0]), []
            if most is None or (last + 1) * len(self.a) <= most:
                for table, (turn, order) in enumerate(turns):
                    moves = np.zeros((2 * m, m))
                    moves[np.arange(2 * m), order % m] = np.where(order < m, -1, 1)
                    names.append(self.names(table, base[table, i] + (template[turn[: last + 1]] @ moves).astype(np.int64)))
            yield np.unique(np.concatenate(names)) if names else none[0], np.array([c[last] for c in costs])

    def probed(self, x: np.ndarray, bound: np.ndarray, recall: float = RECALL) -> list[np.ndarray]:
        """Names of the buckets that each row visits, none where no list of them has the recall."""
        return [names for names, _ in self.plan(x, bound, recall)]

    def placed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each row in each table, and its places inside the slots."""
        positions = self.slots(x)
        base = np.floor(positions).astype(np.int64)
        return base, positions - base

    @staticmethod
    def visited(base: np.ndarray, inside: np.ndarray, cutoffs: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Whether queries with these hashes, places and costs visit the buckets of rows with ``hashes`` in some table."""
        out = np.isinf(cutoffs).any(1)
        for table in range(len(base)):
            move, f = hashes[table] - base[table], inside[table]
            cost = np.where(move < 0, f ** 2, np.where(move > 0, (1 - f) ** 2, 0)).sum(1)
            out |= (np.abs(move) <= 1).all(1) & (cost <= cutoffs[:, table] + 1e-9)
        return out


def _normal(z: np.ndarray) -> np.ndarray:
    """The distribution function of the standard normal distribution."""
    return np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in z.ravel().tolist()]).reshape(z.shape)


def fit_index(points: np.ndarray, tables: int = TABLES, hashes: int = HASHES) -> Index:
    """Projections with slots as wide as the sample's spread asks for."""
    rng = np.random.default_rng(23)
    spread = float(np.sqrt(((points - points.mean(0)) ** 2).sum(1).mean())) or 1.0
    width = WIDTH * spread
    return Index(rng.normal(0, 1, (tables, hashes, points.shape[1])), rng.uniform(0, width, (tables, hashes)), width)


def bounds(x: np.ndarray, own: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Distance of each row to its k-th nearest other point; infinite where there are fewer."""
    out = np.full(len(x), np.inf)
    for i in range(len(x)):
        gap = np.sqrt(((points[ids != own[i]] - x[i]) ** 2).sum(1))
        if len(gap) >= k:
            out[i] = np.partition(gap, k - 1)[k - 1]
    return out


def _hashed(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2048):
                part = batch.slice(first, 2048)
                names = np.stack([Index.names(t, np.floor(p).astype(np.int64)) for t, p in enumerate(index.slots(block(part.column("vec"), index.a.shape[2])))], 1)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("vec"), pa.array(list(names), pa.list_(pa.int64()))], ["id", "vec", "buckets"])

    return run


def _probes(index: Index, known, k: int):
    """Buckets of each query (of short lists), largest costs, and its distance to the k-th nearest row of the sample: no farther row is among its k nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points = known.value
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                x, own = block(part.column("vec"), index.a.shape[2]), part.column("id").to_numpy()
                bound = bounds(x, own, points, ids, k)
                buckets, cutoffs = zip(*index.plan(x, bound, most=LISTED), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("vec"), pa.array(buckets, pa.list_(pa.int64())), pa.array(cutoffs, pa.list_(pa.float64())), pa.array(bound)],
                    ["id", "vec", "buckets", "cutoffs", "bound"])

    return run


def nearest(query: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, distance) of each query's k nearest other rows, ties to smaller ids; distances by exact differences."""
    rough = np.maximum((query ** 2).sum(1)[:, None] + (vectors ** 2).sum(1)[None, :] - 2 * query @ vectors.T, 0)
    rough[query_ids[:, None] == ids[None, :]] = np.inf
    out: tuple[list, list, list] = ([], [], [])
    scale = float((query ** 2).sum(1).max(initial=0) + (vectors ** 2).sum(1).max(initial=0))
    for i in range(len(query)):
        row = rough[i]
        if len(row) > k:  # all that rounding could put among the k nearest
            edge = np.partition(row, k - 1)[k - 1]
            at = np.flatnonzero((row <= edge + 1e-9 * scale) & np.isfinite(row))
        else:
            at = np.flatnonzero(np.isfinite(row))
        gap = np.sqrt(((vectors[at] - query[i]) ** 2).sum(1))
        best = np.lexsort((ids[at], gap))[:k]
        out[0].append(np.full(len(best), query_ids[i]))
        out[1].append(ids[at][best])
        out[2].append(gap[best])
    return tuple(np.concatenate(c) if c else np.zeros(0) for c in out)


def _searched(k: int, dim: int):
    def run(rows: pa.Table) -> pa.Table:
        is_query = rows.column("query").to_numpy(zero_copy_only=False).astype(bool)
        ids, vectors = rows.column("id").to_numpy(), block(rows.column("vec"), dim)
        limits: dict[int, float] = {}
        for i, bound in zip(ids[is_query].tolist(), rows.column("bound").to_numpy(zero_copy_only=False)[is_query].tolist(), strict=True):
            limits[i] = max(bound, limits.get(i, 0.0))
        cell = np.unique(np.stack([rows.column(c).to_numpy() for c in ("bucket", "part", "lot")], 1), axis=0, return_inverse=True)[1].ravel()
        order = np.argsort(cell, kind="stable")
        found = []
        for at in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            asks, has = at[is_query[at]], at[~is_query[at]]
            if len(asks) and len(has):
                found.append(nearest(vectors[asks], ids[asks], vectors[has], ids[has], k))
        q, v, s = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0),) * 3
        if len(q):  # of what the buckets of this group found, each query's k nearest within its bound
            near = s <= np.array([limits[i] for i in q.tolist()]) * (1 + 1e-12)
            q, v, s = q[near], v[near], s[near]
            order = np.lexsort((v, s, q))
            q, v, s = q[order], v[order], s[order]
            fresh = np.append(True, (q[1:] != q[:-1]) | (v[1:] != v[:-1]))
            q, v, s = q[fresh], v[fresh], s[fresh]
            begin = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
            keep = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q)))) < k
            q, v, s = q[keep], v[keep], s[keep]
        return pa.table({"query_id": pa.array(q, pa.int64()), "id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    return run


def _few_equal(vectors: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows without those that k smaller ids with an equal vector precede, and one more that may be the query's own."""
    raw = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * vectors.itemsize))).ravel()
    group = np.unique(raw, return_inverse=True)[1].ravel()
    order = np.lexsort((ids, group))
    first = np.flatnonzero(np.append(True, np.diff(group[order]) > 0))
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return np.sort(order[place <= k])


def _least(i: np.ndarray, j: np.ndarray, gap: np.ndarray, k: int, slack: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that can be among the k nearest of their query i, which lowers ``limit`` in place."""
    order = np.lexsort((gap, i))
    i, j, gap = i[order], j[order], gap[order]
    first = np.flatnonzero(np.append(True, np.diff(i) > 0)) if len(i) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(i)) if len(i) else first
    full = last - first >= k
    at = i[first[full]]
    limit[at] = np.minimum(limit[at], gap[first[full] + k - 1] + 2 * slack[at])
    keep = gap <= limit[i]
    return i[keep], j[keep], gap[keep]


def visited_nearest(
    index: Index, asks: np.ndarray, ask_ids: np.ndarray, bound: np.ndarray, cutoffs: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query id, id, distance) of each query's k nearest other rows within its bound and in buckets up to its costs, ties to smaller ids.

    Distances in single precision, of centred and scaled vectors, leave out what their rounding cannot bring within the bound.
    """
    at = _few_equal(vectors, ids, k)
    vectors, ids = vectors[at].astype(np.float64), ids[at]
    many = k * int(np.unique(ids, return_counts=True)[1].max())  # a key may have several vectors
    centre = vectors.mean(0)
    scale = max(np.abs(vectors - centre).max(), np.abs(asks - centre).max()) or 1.0
    x = ((vectors - centre) / scale).astype(np.float32)
    squares = (x.astype(np.float64) ** 2).sum(1)
    x = np.concatenate([x, squares[:, None].astype(np.float32)], 1)
    hashes = index.placed(vectors)[0]
    for start in range(0, len(asks), ASKS):
        query, own, cut_at = asks[start: start + ASKS], ask_ids[start: start + ASKS], cutoffs[start: start + ASKS]
        base, inside = index.placed(query)
        y = ((query - centre) / scale).astype(np.float32)
        mine = (y.astype(np.float64) ** 2).sum(1)
        y = np.concatenate([-2 * y, np.ones((len(y), 1), np.float32)], 1)  # times a row of x: the squared distance without ``mine``
        slack = (x.shape[1] + 8) * 2.4e-7 * (mine + squares.max()) + 1e-30
        limit = (bound[start: start + ASKS] / scale) ** 2 * (1 + 1e-9) + slack
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for first in range(0, len(x), ROWS):
            rough = y @ x[first: first + ROWS].T
            near = np.flatnonzero(rough <= np.nextafter((limit - mine).astype(np.float32), np.float32(np.inf))[:, None])
            i, j = divmod(near, rough.shape[1])
            fresh.append((i, j + first, rough.ravel()[near] + mine[i]))
            if sum(len(c[0]) for c in fresh) > HITS // 8 or first + ROWS >= len(x):
                i, j, gap = (np.concatenate(c) for c in zip(*fresh, strict=True))
                fresh = []
                seen = np.flatnonzero(ids[j] != own[i])
                seen = seen[index.visited(base[:, i[seen]], inside[:, i[seen]], cut_at[i[seen]], hashes[:, j[seen]])]
                held.append((i[seen], j[seen], gap[seen]))
                if sum(len(c[0]) for c in held) > HITS or not np.isfinite(limit).all():
                    held = [_least(*(np.concatenate(c) for c in zip(*held, strict=True)), many, slack, limit)]
        i, j, _ = _least(*(np.concatenate(c) for c in zip(*held, strict=True)), many, slack, limit)
        if not len(i):
            continue
        gap = np.concatenate([np.sqrt(((vectors[j[s: s + ROWS]] - query[i[s: s + ROWS]]) ** 2).sum(1)) for s in range(0, len(i), ROWS)])
        inner = gap <= bound[start + i] * (1 + 1e-12)
        i, v, gap = i[inner], ids[j[inner]], gap[inner]
        order = np.lexsort((gap, v, i))
        i, v, gap = i[order], v[order], gap[order]
        fresh = np.append(True, (np.diff(i) != 0) | (np.diff(v) != 0))[: len(i)]  # a key's nearest vector
        i, v, gap = i[fresh], v[fresh], gap[fresh]
        order = np.lexsort((v, gap, i))
        i, v, gap = i[order], v[order], gap[order]
        begin = np.flatnonzero(np.append(True, np.diff(i) != 0)[: len(i)])
        keep = np.arange(len(i)) - np.repeat(begin, np.diff(np.append(begin, len(i)))) < k
        yield own[i[keep]], v[keep], gap[keep]


def _scanned(index: Index, k: int, dim: int):
    def run(rows: pa.Table) -> pa.Table:
        is_query = rows.column("query").to_numpy(zero_copy_only=False).astype(bool)
        raw = b"".join(b for c in rows.column("vec").chunks for b in c.to_pylist())
        vectors, ids = np.frombuffer(raw, f"<f{len(raw) // dim // rows.num_rows}").reshape(-1, dim), rows.column("id").to_numpy()
        found = []
        if is_query.any() and not is_query.all():
            asked = rows.filter(pa.array(is_query))
            cutoffs = np.array(asked.column("cutoffs").to_pylist(), float).reshape(asked.num_rows, -1)
            found = list(visited_nearest(
                index, vectors[is_query].astype(np.float64), ids[is_query], asked.column("bound").to_numpy(), cutoffs, vectors[~is_query], ids[~is_query], k))
        q, v, s = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0),) * 3
        return pa.table({"query_id": pa.array(q, pa.int64()), "id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    return run


def _scan(table: DataFrame, rows: int, asked: DataFrame, index: Index, k: int, dim: int) -> DataFrame:
    """Compare queries with all rows that their costs let them visit: parts of the rows meet lots of the queries."""
    most = max(1024, COMPONENTS // dim)
    parts = math.ceil(rows / min(most, max(1024, int(PART * math.sqrt(rows)))))
    lots = max(1, math.ceil(asked.count() / min(most, LOT)))
    stored = table.select(
        F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"),
        F.lit(False).alias("query"), "id", "vec", F.lit(0.0).alias("bound"), F.lit(None).cast("array<double>").alias("cutoffs"))
    seekers = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(lots)).cast("int").alias("lot"),
        F.lit(True).alias("query"), "id", "vec", "bound", "cutoffs")
    return stored.unionByName(seekers).groupBy("part", "lot").applyInArrow(_scanned(index, k, dim), "query_id long, id long, score double")


def search(vectors: DataFrame, queries, key: str = "vec_id", embedding: str = "embedding", k: int = 10) -> DataFrame:
    """(query_id, rank, id, score): each query's ``k`` nearest found by Euclidean distance, nearest first, ties to smaller ids.

    ``queries`` is a condition on ``vectors`` that picks the queries; every other row is a candidate.
    Vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take no
    part; neither do rows with a null key. Equal vectors are candidates each; rows that repeat a key and a
    vector count once, and a key with several vectors is found by its nearest.
    A task returns no row farther than the query's k-th nearest in the sample, which bounds its true k-th distance.
    Large buckets are cut into blocks by hash of the key, so that a task compares at most BLOCK rows with
    QUERY_BLOCK queries. The sample has at most one row in SHARE of the table, so that its bound is above the k-th
    distance at every size and does not decide what is found. A query with more than LISTED buckets meets parts of the table, in which it
    finds the rows of its buckets by their costs: it travels once for each part, the rows once for each lot of such queries. A query whose
    buckets do not reach RECALL at its bound, or hold fewer than ``k`` candidates, is compared with the whole table in the same way.
    """
    spark = vectors.sparkSession
    table = cut(packed(vectors.filter(F.col(key).isNotNull()), {"id": F.col(key).cast("long"), "query": F.coalesce(queries, F.lit(False))}, embedding).distinct())
    ids, points = sample(table, "id", SAMPLE)
    empty = spark.createDataFrame([], "query_id long, rank int, id long, score double")
    if not len(points):
        return empty
    table = table.filter(F.col("dim") == points.shape[1])
    index = fit_index(points)
    stored = table.select("id", "vec").mapInArrow(_hashed(index), "id long, vec binary, buckets array<long>").select("id", "vec", F.explode("buckets").alias("bucket"))
    single = np.unique(ids, return_index=True)[1]
    rows = table.count()
    single = np.random.default_rng(29).permutation(single)[: max(1, rows // SHARE)]
    known = spark.sparkContext.broadcast((ids[single], points[single]))  # the sample, about SAMPLE vectors
    asked = cut(table.filter("query").select("id", "vec").mapInArrow(_probes(index, known, k), "id long, vec binary, buckets array<long>, cutoffs array<double>, bound double"))
    dim = points.shape[1]
    listed = asked.filter(F.size("buckets") > 0)
    found = empty.drop("rank")
    if asked.filter(F.size("buckets") == 0).head(1):
        found = _scan(table, rows, asked.filter(F.size("buckets") == 0), index, k, dim)
    if listed.head(1):
        found = found.unionByName(_blocks(stored, listed.select("id", "vec", "bound", F.explode("buckets").alias("bucket")), k, dim))
    best = _ranked(found, k)
    counts = best.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n"))
    short = cut(asked.select("id").distinct().join(counts, "id", "left").filter(f"n is null or n < {k}").select("id"))
    if short.head(1):
        rest = table.filter("query").join(short, "id", "left_semi").select(
            "id", "vec", F.lit(float("inf")).alias("bound"), F.array_repeat(F.lit(float("inf")), len(index.a)).alias("cutoffs"))
        every = _ranked(_scan(table, rows, rest, index, k, dim), k)
        best = best.join(short.withColumnRenamed("id", "query_id"), "query_id", "left_anti").unionByName(every)
    return best.select("query_id", "rank", "id", "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """Each query's k nearest of all that was found."""
    merged = found.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "id")
    return cut(merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))


def _blocks(stored: DataFrame, asked: DataFrame, k: int, dim: int) -> DataFrame:
    """Compare the queries and the rows of each bucket block by block."""
    wanted = asked.groupBy("bucket").agg(F.count("*").alias("n_asked"))
    counts = cut(stored.groupBy("bucket").agg(F.count("*").alias("n_stored")).join(wanted, "bucket").select(
        "bucket", "n_stored", "n_asked", F.ceil(F.col("n_stored") / BLOCK).cast("int").alias("parts"), F.ceil(F.col("n_asked") / QUERY_BLOCK).cast("int").alias("lots")))
    own = counts.select("bucket", "parts", "lots")
    rows = stored.join(own, "bucket").select(
        "bucket", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), F.lit(False).alias("query"), "id", "vec", F.lit(0.0).alias("bound"))
    seekers = asked.join(own, "bucket").select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("id"), F.col("lots")).cast("int").alias("lot"), F.lit(True).alias("query"), "id", "vec", "bound")
    # blocks of small buckets share a group; a group holds about BLOCK rows, at most a few blocks more
    total = counts.agg(F.sum(F.col("n_stored") * F.col("lots") + F.col("n_asked") * F.col("parts"))).first()[0] or 0
    group = F.pmod(F.xxhash64("bucket", "part", "lot"), F.lit(max(1, total // BLOCK)))
    return rows.unionByName(seekers).groupBy(group.alias("group")).applyInArrow(_searched(k, dim), "query_id long, id long, score double")
