import random
import re

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
import xxhash

from tidemark.llm import simhash
from tidemark.llm.embedding_dedup import Grid, near_embeddings
from tidemark.llm.queries import ORACLES, QUERIES
from tidemark.llm.tables import components, local_roots
from tidemark.llm.vectors import means

SF = "/root/testdata/sf0.001"


def least_reachable(links):
    label = np.arange(len(links))
    while True:
        new = np.minimum(np.where(links, label[None, :], len(label)).min(1), label)
        if (new == label).all():
            return label
        label = new


def brute_print(body):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), body or ""))
    shingles = [" ".join(words[i: i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_query_against_brute_force(spark, documents):
    rows = QUERIES["op3_simhash"](spark, SF).toPandas().set_index("doc_id").loc[documents.doc_id]
    prints = [brute_print(t) for t in documents.text]
    assert rows.fingerprint.tolist() == [f"{p:016x}" for p in prints]
    f, ids = np.array(prints, np.uint64), documents.doc_id.to_numpy()
    order = np.argsort(ids)
    label = least_reachable(np.bitwise_count(f[order][:, None] ^ f[order][None, :]) <= 3)
    want = dict(zip(ids[order], ids[order][label]))
    assert rows.component_id.tolist() == [want[i] for i in ids]
    assert len(set(want.values())) < len(ids)


def test_tiles_miss_no_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 4)
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    prints = set(base.tolist())
    for p in base.tolist():
        for n in (1, 2, 3, 4):
            prints.add(p ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)))
    prints |= {0, (1 << 64) - 1, 7, 15}
    f = np.array(sorted(prints), np.uint64)
    frame = spark.createDataFrame(pd.DataFrame({"node": np.arange(len(f)), "fingerprint": f.view(np.int64)}))
    got = components(simhash.near_links(frame)).toPandas().set_index("node").root
    label = least_reachable(np.bitwise_count(f[:, None] ^ f[None, :]) <= 3)
    assert [got.get(i, i) for i in range(len(f))] == label.tolist()


def test_group_of_thousands_of_near_copies(spark):
    rng = np.random.default_rng(1)
    f = np.unique(np.uint64(0x0F0F0F0F0F0F0F0F) ^ (np.uint64(1) << rng.integers(0, 64, 9000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 9000).astype(np.uint64)))
    frame = spark.createDataFrame(pd.DataFrame({"node": np.arange(len(f)) + 5, "fingerprint": f.view(np.int64)}))
    links = simhash.near_links(frame).cache()
    got = components(links).toPandas()
    assert links.count() < 40 * len(f) and len(got) == len(f) and set(got.root) == {5}


@pytest.mark.parametrize("n,m", [(200, 150), (1000, 900), (300, 299)])
def test_components(spark, n, m):
    rng = np.random.default_rng(n)
    ends = rng.integers(0, n, (m, 2)) if m != n - 1 else np.stack([np.arange(n - 1), np.arange(1, n)], 1)  # a path last
    ends = rng.permutation(n)[ends]
    got = components(spark.createDataFrame(pd.DataFrame(ends, columns=["src", "dst"])).repartition(5)).toPandas()
    links = np.zeros((n, n), bool)
    links[ends[:, 0], ends[:, 1]] = links[ends[:, 1], ends[:, 0]] = True
    label = least_reachable(links)
    assert got.node.is_unique and (label[got.node] == got.root).all()
    assert set(got.node) == set(ends[ends[:, 0] != ends[:, 1]].ravel())


def test_components_without_links(spark):
    assert components(spark.createDataFrame([(3, 3)], "src long, dst long")).count() == 0
    nodes, roots = local_roots(np.array([5, 9]), np.array([7, 5]))
    assert nodes.tolist() == [5, 7, 9] and roots.tolist() == [5, 5, 5]


def test_simhash_of_odd_rows(spark, odd_documents, no_documents):
    groups = simhash.simhash_groups(odd_documents).toPandas()
    assert len(groups) == 12 and (groups[groups.doc_id == 1].component_id == 1).all()
    assert set(groups[groups.doc_id.isin([2, 3, 4])].component_id) == {2}  # texts without words are linked
    assert groups[groups.doc_id.isna()].component_id.dropna().tolist() == [1, 2] or sorted(groups[groups.doc_id.isna()].component_id.dropna()) == [1, 2]
    kept = simhash.representatives(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 5, 6, 7] and sum(i is None for i in ids) == 1
    assert simhash.simhash_groups(no_documents).count() == 0 and simhash.representatives(no_documents).count() == 0


def test_embedding_query_against_its_statement(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet')")
    want = con.execute(ORACLES["op1_embedding_dedup"]).fetchdf().sort_values("vec_id").reset_index(drop=True)
    got = QUERIES["op1_embedding_dedup"](spark, SF).toPandas().sort_values("vec_id").reset_index(drop=True)
    assert got.equals(want[got.columns])


def test_cells_within_the_radius_are_all_visited():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16))
    x[200:] = x[:200] + rng.normal(scale=0.04, size=(200, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    grid = Grid(means(x[:, :8], 16, 1), means(x[:, 8:], 16, 2))
    cells, visits = grid.cells(x), grid.visits(x, 0.2)
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= 0.04
    assert near.sum() > len(x)
    assert all(cells[j] in visits[i] for i, j in zip(*np.nonzero(near)))
    assert np.mean([len(v) for v in visits]) < 100  # of 256


def test_embedding_groups_against_brute_force(spark, monkeypatch):
    from tidemark.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    x = np.concatenate([centres[rng.integers(0, 12, 240)] + rng.normal(scale=0.09, size=(240, 8)), np.repeat(centres[:1], 60, 0)])
    label = rng.integers(0, 2, len(x))
    rows = [(i, [float(c) for c in v], int(k)) for i, (v, k) in enumerate(zip(x, label))]
    got = near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).toPandas().set_index("vec_id").sort_index()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(links, False)
    root = least_reachable(links)
    assert got.n_links.tolist() == links.sum(1).tolist() and links.sum() > 1000
    assert got.component_id.tolist() == root.tolist() and got.kept.tolist() == (root == np.arange(len(x))).tolist()


def test_odd_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1, 9), (2, [2.0, 0.0], 1, 9), (3, [1.0, 0.0], 2, 9), (4, [1.0, 0.0], None, 9), (5, None, 1, 9), (6, [0.0, 0.0], 1, 9), (7, [nan, 1.0], 1, 9),
        (8, [inf, 1.0], 1, 9), (9, [None, 1.0], 1, 9), (10, [], 1, 9), (11, [1.0], 1, 9), (12, [1e-30, 0.0], 1, 9), (2, [2.0, 0.0], 1, 9), (None, [1.0, 0.0], 1, 9)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n int").selectExpr("*", "1 as node", "2 as cell")
    got = near_embeddings(frame).toPandas()
    assert len(got) == len(rows)
    linked = got[got.n_links > 0].sort_values("vec_id")
    assert linked.vec_id.tolist() == [1, 2, 2, 12] and set(linked.component_id) == {1} and set(linked.n_links) == {2}
    assert near_embeddings(frame.filter("false")).count() == 0


def test_vectors_travel_once_for_each_shelf(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(8_000, 64)).astype(np.float32)
    x[4_000:4_400] = x[:400] + rng.normal(scale=0.05, size=(400, 64))
    frame = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int").repartition(4).cache()
    frame.count()

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    before = shuffled()
    got = near_embeddings(frame).toPandas()
    moved = shuffled() - before
    frame.unpersist()
    assert (got.n_links == 1).sum() == 800 and (got.component_id != got.vec_id).sum() == 400
    assert moved < 8 * x.nbytes  # a copy for each cell that a vector visits: 12.5 times


def test_shelves_that_are_reached_hold_all_cells_that_are_visited():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    grid = Grid(means(x[:, :8], 8, 1), means(x[:, 8:], 8, 2))
    left, right = grid.bounds(x)
    visits = grid.visits(x, 0.2)
    for first, last in [(0, 0), (3, 6), (5, 9), (5, 17), (8, 40), (0, 63), (63, 63)]:
        assert grid.reaches(left, right, first, last, 0.2).tolist() == [any(first <= c <= last for c in v) for v in visits]
